"""N-gram Jaccard join with several global token orders.

Two documents whose shingle sets have a Jaccard similarity of t or more share a token in a short prefix of either set, under any order
of the tokens that all documents use. Candidates must pass under several orders before their sets are compared:

1. by hash, for documents: of the first (1 - t + SPARE) of a set's tokens, a share must occur in another document's prefix too;
2. rarest first, for pairs: a shared token in the prefixes under the document frequencies among what is left. Tokens of common passages come
   last there, and tokens of one document alone, which can't be shared, take up prefix places first;
3. by hash from the other end, and by hash once more, for those pairs: prefixes meet, sets don't, and a pair that passes only some filters ends here.

What passes all filters is verified on the whole sets.

No group is emitted pair by pair. Equal sets are one representative. In each bucket of order 2 all are compared with one centre, the
document whose tokens are the most frequent, as an original's are among its copies. What such a star leaves unlinked is compared with the rest of
the star in blocks of sets, so that no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlens.llm.batches import slices
from emberlens.llm.shingles import shingle_set, signature
from emberlens.llm.sieve import COMMON, join_common, sieve, sift
from emberlens.operators.components import connected_components
from emberlens.shared import materialize

WORDS, PERCENT = 4, 85
#: Share of a set by which the prefixes of order 1 are longer than they must be; so many shared tokens are then asked for.
SPARE = 10
#: Rows of the broadcast that thins texts out before the exact join: at most so many, whatever the input.
SIEVE = 1 << 20
#: Sets that one matrix product compares on each side, and tokens of the sets in a block that is shipped (eight bytes each).
BLOCK, BLOCK_TOKENS = 256, 500_000


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any partner."""
    return -(-percent * n // 100)


def _prefix(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _need(n: Column, percent: int) -> Column:
    """Shared tokens asked for in order 1: the spare of the smallest partner."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) * SPARE / 100))


def _blob_sets(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        n, s1, s2, prefixes = [], [], [], []
        for text in batch.column(1).to_pylist():
            h = shingle_set((text or "").encode(), words)
            a, b = signature(h)
            n.append(len(h))
            s1.append(a)
            s2.append(b)
            prefixes.append(h[: _prefix(len(h), percent) - 1 + max(1, SPARE * len(h) // 100)] if len(h) else h)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
            ["doc_id", "n", "sig1", "sig2", "prefix"],
        )


def shingle_prefixes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (size of the set), sig1, sig2 (128 bits for the set), prefix under order 1."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _blob_sets(b, words, percent), "doc_id long, n int, sig1 long, sig2 long, prefix array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(rep, sig1, text) -> rep, sig1, n, tokens, for the rows whose set has that signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            reps, sigs, sets = [], [], []
            for rep, sig1, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingle_set((text or "").encode(), words)
                if signature(h)[0] == sig1:
                    reps.append(rep)
                    sigs.append(sig1)
                    sets.append(h.view(np.int64))
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sigs, pa.int64()), pa.array(np.diff(cuts).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["rep", "sig1", "n", "tokens"])

    return texts.select("rep", "sig1", "text").mapInArrow(work, "rep long, sig1 long, n int, tokens array<long>")


def _pick(column: pa.ListArray) -> list[np.ndarray]:
    """The lists as sorted unsigned arrays (they were sorted so when made)."""
    flat, cuts = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return bool(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))


def _long_prefix(n: Column, percent: int) -> tuple[Column, Column]:
    """Tokens in a set's longer prefix, and its spare: two linked sets share as many tokens of their prefixes as the smaller spare says, under any order."""
    spare = F.greatest(F.lit(1), F.floor(n * SPARE / 100)).cast("int")
    return n - F.ceil(n * percent / 100).cast("int") + spare, spare


def filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> the pairs that pass the filters by size and of orders 3 and 1: their longer prefixes under each order share enough tokens. Sets aren't shipped."""
    length, spare = _long_prefix(F.col("n"), percent)
    heads = sets.select("rep", "n", spare.alias("spare"), F.slice("tokens", F.lit(1), length).alias("low"), F.slice("tokens", -length, length).alias("high"))
    heads = materialize(heads, "shingle-heads")
    left, right = (heads.select(*[F.col(c).alias(f"{c}_{side}") for c in heads.columns]) for side in "ab")
    both = pairs.join(left, F.col("a") == F.col("rep_a")).join(right, F.col("b") == F.col("rep_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    enough = [F.size(F.array_intersect(f"{side}_a", f"{side}_b")) >= F.least("spare_a", "spare_b") for side in ("high", "low")]
    return both.where(near).where(enough[0]).where(enough[1]).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> the pairs whose sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(x, y, percent) for x, y in zip(_pick(batch.column(2)), _pick(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def block_links(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], sets: tuple[list, list], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets in different components. Intersections of all pairs are one matrix product over the shared tokens."""
    sizes = [np.array([len(s) for s in side]) for side in sets]
    flats = [np.concatenate(side) for side in sets]
    shared = np.intersect1d(np.unique(flats[0]), np.unique(flats[1]))
    common = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    for at in range(0, len(shared), 16384):
        some, marks = shared[at : at + 16384], []
        for flat, n in zip(flats, sizes, strict=True):
            mark = np.zeros((len(n), len(some)), np.float32)
            where = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[where] == flat
            mark[np.repeat(np.arange(len(n)), n)[hit], where[hit]] = 1
            marks.append(mark)
        common += marks[0] @ marks[1].T
    ok = similar(common, sizes[0][:, None], sizes[1][None, :], percent) & (groups[0][:, None] != groups[1][None, :])
    return [(int(ids[0][i]), int(ids[1][j])) for i, j in zip(*np.nonzero(ok), strict=True)]


def _open_links(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the stars left open: in each star whose members aren't all in the centre's component, those outside it against all members.

    ``stars``: (a member, b centre). Sets go into blocks of about BLOCK_TOKENS tokens by hash, and each pair of blocks is one row and one task's work: a
    star's sets are copied once for each block of the other side, so most stars are shipped once.
    """
    component = F.coalesce("component", "node")
    named = stars.select("a").union(stars.select("b")).distinct().withColumnRenamed("a", "node").join(labels, "node", "left").select("node", component.alias("component"))
    placed = stars.join(named.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(named.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    placed = placed.join(sets.select(F.col("rep").alias("a"), "n"), "a").withColumn("out", F.col("ca") != F.col("cb"))
    size = placed.groupBy("b").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("out"), F.col("n"))).alias("out_tokens")).where("out_tokens > 0 AND members > 1")
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK_TOKENS).cast("int")
    placed = materialize(placed.join(size, "b").select("a", "b", "ca", "out", blocks_of("tokens").alias("blocks"), blocks_of("out_tokens").alias("out_blocks")), "open-stars")
    whole = placed.join(sets.select(F.col("rep").alias("a"), "tokens"), "a")

    def dealt(rows: DataFrame, own: str, others: str, names: list[str]) -> DataFrame:
        placed = rows.withColumn(names[0], F.pmod(F.xxhash64("a"), F.col(own)).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return placed.select(*[F.col(c).alias(c) for c in ("b", "i", "j", "a", "ca", "tokens")])

    def work(outer: pa.Table, inner: pa.Table) -> pa.Table:
        sides = []
        for table in (outer, inner):
            ids, groups, sets_ = table.column("a").to_numpy(), table.column("ca").to_numpy(), [s for chunk in table.column("tokens").chunks for s in _pick(chunk)]
            sides.append([(ids[i : i + BLOCK], groups[i : i + BLOCK], sets_[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)])
        found = [link for x in sides[0] for y in sides[1] for link in block_links(*zip(x, y, strict=True), percent)]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["b", "i", "j"]
    outer, inner = dealt(whole.where("out"), "out_blocks", "blocks", ["i", "j"]), dealt(whole, "blocks", "out_blocks", ["j", "i"])
    return outer.groupBy(*keys).cogroup(inner.groupBy(*keys)).applyInArrow(work, "a long, b long")


def _with_tokens(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Inner join of rows (token, ...) with tokens (token, df, ...) that were counted among them and written: one row each. Tokens were counted before any shuffle, so a token that
    every document has came as a row from each task; here its rows go to several tasks, and rows whose token can't be among the counted ones don't travel."""
    common = counted.where(F.col("df") >= COMMON).select(F.xxhash64("token").alias("h"))
    return join_common(sift(rows, "token", sieve(counted, "token")).withColumn("h", F.xxhash64("token")), counted, "token", common).drop("h")


def near_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id: a row for each document.

    A document's set: distinct hashes of its runs of ``words`` words (A-Z read as a-z; words are what stands between white-space bytes), of the
    whole sequence where there are fewer words. Documents are linked when 100 * common >= percent * union; component_id is the smallest doc_id
    reachable by links. Null and empty texts and texts of white space have the empty set and are linked with nothing. Null doc_ids are
    never a component's name. Repeated rows come back as often; rows of one doc_id with different texts are linked as what they
    are, each by its own text. Other columns are ignored; an empty table gives no rows. Texts are read whole.
    """
    docs = docs.select("doc_id", "text")
    prefixes = materialize(shingle_prefixes(docs, words, percent), "shingle-prefixes")
    full = prefixes.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")), "shingle-classes")

    # order 1: documents with enough tokens that another set's prefix has too. A set stands for all its copies.
    tokens = full.select(F.explode("prefix").alias("token"), "sig1")
    shared = tokens.groupBy("token").agg(F.min("sig1").alias("low"), F.max("sig1").alias("high"), F.count(F.lit(1)).alias("df")).where("low <> high")
    counted = _with_tokens(tokens, materialize(shared.select("token", "df"), "shared-tokens")).groupBy("sig1").agg(F.count(F.lit(1)).alias("got"))
    left = materialize(counted.join(classes, "sig1").where(F.col("got") >= _need(F.col("n"), percent) * F.col("copies")).select("rep", "sig1"), "shingle-left")

    slots = left.select(F.pmod(F.xxhash64("rep"), F.lit(SIEVE)).cast("int").alias("slot")).distinct()
    thin = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).cast("int")).join(F.broadcast(slots), "slot", "left_semi")
    texts = thin.join(left, F.col("doc_id") == F.col("rep")).select("rep", "sig1", "text")
    sets = materialize(_sets(texts, words), "shingle-sets")

    # order 2: rarest first
    rows = sets.select("rep", "sig1", "n", F.explode("tokens").alias("token"))
    frequency = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token-counts")
    ordered = _with_tokens(rows, frequency).groupBy("rep", "sig1", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("known"), F.sum(F.log("df")).alias("fame"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - F.size("known"))
    buckets = ordered.where(length > 0).select("rep", (F.col("fame") / F.col("n")).alias("fame"), F.explode(F.slice("known", F.lit(1), length)).alias("k")).select("rep", "fame", F.col("k.token").alias("token"))
    buckets = materialize(buckets, "shingle-buckets")
    centres = buckets.groupBy("token").agg(F.max(F.struct("fame", (-F.col("rep")).alias("id"))).alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", (-F.col("top.id")).alias("b"))
    stars = materialize(buckets.join(centres, "token").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "shingle-stars")

    candidates = materialize(filtered(stars, sets, percent), "shingle-pairs")
    links = materialize(_verified(candidates, sets, percent), "shingle-links")
    labels = connected_components(links)
    more = materialize(_open_links(stars, labels, sets, percent), "shingle-more")
    if more.limit(1).count():
        labels = connected_components(links.union(more))

    named = classes.select("sig1", "sig2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("sig1", "sig2", F.coalesce("component", "rep").alias("component_id"))
    some = prefixes.where("n > 0").select("doc_id", "n", "sig1", "sig2").join(named, ["sig1", "sig2"], "left").select("doc_id", "n", "component_id")
    none = prefixes.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.union(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


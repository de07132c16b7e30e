r"""Near-duplicate lines by a deletion-neighbourhood join: the earliest of each stays. All DataFrame functions.

Two lines are near when one edit (insertion, deletion or substitution of a code point) or none turns one into the other. Each line
emits the hashes of all its variants with one code point deleted, and of itself; lines that share a variant are joined, the edit distance
is verified, and a line goes when an earlier one (by doc_id, then line number) is within the bound.

How the variants stay few. Cut a line of n code points into k blocks, the blocks before one of them counted from the line's start and those behind it
from its end. Two lines one edit apart agree in all but one block: with m the shorter length and w = m // k, common prefix + common
suffix >= m - 1, so the block that holds the end of the common prefix has all of the difference. So lines are narrowed down twice, first by
halves (k = 2), then by short blocks, and only a block whose surroundings another distinct line has too emits its variants. This loses nothing.

Why no group is emitted pair by pair. A variant is keyed with its position when it stands for a substitution: all lines under
such a key are one edit apart from each other, so each is compared with the earliest alone. A variant keyed by its content alone meets the
one distinct line that equals it; each side is compared with the earliest of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlens.llm.names import spared
from emberlens.llm.sieve import COMMON, SALTS, marked, sieve, sift
from emberlens.shared import materialize

#: Shorter lines (in code points, without spaces at the ends) are never near others: an edit in "Of it." says nothing.
MIN_CHARS = 30
#: Code points in a short block at least, and blocks in a line at most: a block of a very long line is longer.
BLOCK, MOST_BLOCKS = 16, 1024


def _order(doc_id: Column, line_no: Column) -> Column:
    """One number that sorts as (doc_id, line_no), null doc_id last; a decimal, so that min() over it stays a hash aggregate."""
    return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit("10000000000000000000").cast("decimal(20,0)")) * F.lit("4294967296").cast("decimal(10,0)") + line_no.cast("decimal(10,0)")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line_no, line (trimmed), at (its order), h1, h2 (128 bits of hash) for the lines that can be removed: those of ``min_chars`` or more."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    split = split.select("doc_id", "line_no", F.trim("line").alias("line")).where(F.length("line") >= min_chars)
    return split.select("doc_id", "line_no", "line", _order(F.col("doc_id"), F.col("line_no")).alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


def _half_keys() -> Column:
    """Hashes of a line's first and last half. Halves are of 4 * (m // 8) code points, m the shorter length of a pair: two sizes where m may be n - 1."""
    n = F.length("line")

    def pair(eighth: Column) -> list[Column]:
        cut = eighth * 4
        return [F.xxhash64(eighth, F.lit(0), F.substr("line", F.lit(1), cut)), F.xxhash64(eighth, F.lit(1), F.substr("line", n - cut + 1, cut))]

    eighth = F.floor(n / 8).cast("int")
    return F.when(n % 8 == 0, F.array(*pair(eighth), *pair(eighth - 1))).otherwise(F.array(*pair(eighth)))


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, line_no) of each line that repeats an earlier one within ``max_edits`` (0 or 1).

    Line numbers count from 0. Lines are compared without spaces at their ends (tabs and other white space count). Lines of ``min_chars`` or more can go; with ``exact_chars``,
    exact repeats of lines from that length on go too (1: of every line that isn't empty).
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1: with more, lines under one key needn't be near each other")
    lines = _lines(docs.select("doc_id", "text"), min_chars if exact_chars is None else min(exact_chars, min_chars))
    halves = F.when(F.length("line") >= min_chars, _half_keys())  # null, so without a row below, for lines that only go as exact repeats
    places = materialize(lines.select("doc_id", "line_no", "h1", "h2", halves.alias("halves")), "line-places")
    at = _order(F.col("doc_id"), F.col("line_no"))
    counts = materialize(places.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-copies")
    copies = counts.select("h1", "h2", "first")
    if max_edits:
        # lines that share a half with another distinct line
        halves = places.select(F.explode("halves").alias("half"), "h1")
        shared = materialize(halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half"), "line-halves")
        asked = materialize(sift(halves, "half", sieve(shared, "half")).join(shared, "half", "left_semi").select("h1").distinct(), "line-asked")
        through = sieve(asked, "h1")
        first = sift(places.select("h1", "h2", at.alias("at")), "h1", through).join(asked, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("at").alias("at"))
        near = sift(lines.select("line", "at", "h1", "h2"), "h1", through).join(first, ["h1", "h2", "at"])
        near = materialize(near.select("line", "at", "h1", "h2").dropDuplicates(["h1", "h2"]), "line-near")
        gone = near_pairs(near).select("h1", "h2", F.lit(None).cast("decimal(31,0)").alias("first")).distinct()
        copies = copies.select("h1", "h2", F.col("first").cast("decimal(31,0)").alias("first")).union(gone)
        # a removed text goes wherever it stands: all its places come after a line that is near
        copies = copies.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.bool_or(F.col("first").isNull()).alias("all"))
    else:
        copies = copies.withColumn("all", F.lit(False))
    # a very common line is joined in SALTS parts; both sides ask the same sieve, so a line that only seems common is joined whole too
    common = sieve(materialize(counts.where(F.col("n") > COMMON).select("h1"), "line-common"), "h1")
    salts = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = marked(copies, "h1", common, "common").withColumn("salt", F.explode(salts)).drop("common")
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SALTS)).cast("int")).otherwise(0)
    asked_for = marked(places.select("doc_id", "line_no", "h1", "h2"), "h1", common, "common").withColumn("salt", salt)
    found = asked_for.join(copies, ["h1", "h2", "salt"]).where(F.col("all") | (at > F.col("first")))
    return found.select("doc_id", "line_no").distinct()


def _xors(hashes: Column) -> Column:
    """[h0, h1, ...] -> [0, h0, h0 ^ h1, ...]."""
    begin = F.struct(F.lit(0).cast("long").alias("last"), F.array(F.lit(0).cast("long")).alias("all"))

    def step(done: Column, h: Column) -> Column:
        now = done["last"].bitwiseXOR(h)
        return F.struct(now.alias("last"), F.array_append(done["all"], now).alias("all"))

    return F.aggregate(hashes, begin, step, lambda done: done["all"])


def _blocks(near: DataFrame) -> DataFrame:
    """at, key (hash of all of the line but the block), start, size: a row for each block of each line.

    A line is read twice, whatever the number of its blocks: once cut from the front, once from the end; a key joins the hashes of
    the pieces before its block with those of the pieces behind it.
    """
    n = F.length("line")

    def cut(m: Column) -> Column:
        width = F.greatest(F.lit(BLOCK), F.ceil(m / MOST_BLOCKS)).cast("int")
        return F.struct(width.alias("width"), F.greatest(F.lit(1), F.floor(m / width)).cast("int").alias("count"))

    cuts = near.select("at", "line", F.explode(F.array_distinct(F.array(cut(n), cut(n - 1)))).alias("c"))
    cuts = cuts.select("at", "line", n.alias("n"), F.col("c.width").alias("width"), F.col("c.count").alias("count"))
    outer, piece = (F.col("count") - 1) * F.col("width"), F.concat(F.lit("(?s).{"), F.col("width").cast("string"), F.lit("}"))
    hashes = lambda part: F.transform(F.regexp_extract_all(part, piece, F.lit(0)), lambda x, i: F.xxhash64(i, x))
    cuts = cuts.withColumn("front", _xors(hashes(F.substr("line", F.lit(1), outer)))).withColumn("back", _xors(F.reverse(hashes(F.substr("line", F.col("n") - outer + 1, outer)))))
    each = cuts.select("at", "n", "width", "count", "front", "back", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"))
    before, behind = F.col("k") * F.col("width"), (F.col("count") - 1 - F.col("k")) * F.col("width")
    key = F.xxhash64("width", "count", "k", F.get("front", F.col("k")), F.get("back", F.col("count") - 1 - F.col("k")))
    return each.select("at", key.alias("key"), before.alias("start"), (F.col("n") - before - behind).alias("size"))


def near_pairs(near: DataFrame) -> DataFrame:
    """Distinct lines (line, at, h1, h2) -> those with an earlier line one edit away: at, h1, h2, keeper (the earlier line's at)."""
    blocks = materialize(_blocks(near), "line-blocks")
    shared = materialize(blocks.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("key"), "line-shared")
    live = sift(blocks, "key", sieve(shared, "key")).join(shared, "key", "left_semi")
    emit = live.join(near, "at").select("at", "key", "start", "size", F.length("line").alias("n"), F.substr("line", F.col("start") + 1, F.col("size")).alias("block"))
    cut_out = lambda i: F.concat(F.substr("block", F.lit(1), i - 1), F.substr("block", i + 1, F.col("size")))
    deleted = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.struct(F.xxhash64("key", cut_out(i)).alias("content"), i.alias("i")))
    whole = F.array(F.struct(F.xxhash64("key", "block").alias("content"), F.lit(0).alias("i")))
    variants = emit.select("at", "start", "size", (F.col("n") - F.col("start") - F.col("size")).alias("behind"), F.explode(F.concat(whole, deleted)).alias("v"))
    variants = materialize(variants.select("at", "start", "size", "behind", F.col("v.content").alias("content"), F.col("v.i").alias("i")), "line-variants")
    substituted = variants.where("i > 0").select("at", "start", "behind", F.xxhash64("content", "size", "i").alias("key"), F.lit(1).alias("role"))
    inserted = variants.select("at", "start", "behind", F.col("content").alias("key"), F.when(F.col("i") > 0, 2).otherwise(3).alias("role"))
    members = substituted.union(inserted)
    groups = members.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"first{r}") for r in (1, 2, 3)], F.max(F.when(F.col("role") == 1, F.col("at"))).alias("last1"))
    groups = materialize(groups.where("first1 < last1 OR (first2 IS NOT NULL AND first3 IS NOT NULL)"), "line-groups")
    keeper = F.when(F.col("role") == 1, F.col("first1")).when(F.col("role") == 2, F.col("first3")).otherwise(F.col("first2"))
    pairs = sift(members, "key", sieve(groups, "key")).join(groups, "key").select("at", "start", "behind", keeper.alias("keeper")).where("keeper < at").distinct()
    earlier = near.select(F.col("at").alias("keeper"), F.col("line").alias("kept"))
    return pairs.join(near, "at").join(earlier, "keeper").where(_one_edit()).select("at", "h1", "h2", "keeper").distinct()


def _one_edit() -> Column:
    """Line and kept agree before and behind their blocks, and the blocks are one edit apart: the distance is counted over blocks, not over long lines."""
    parts = {c: (F.substr(c, F.lit(1), F.col("start")), F.substr(c, F.length(c) - F.col("behind") + 1, F.col("behind")), F.substr(c, F.col("start") + 1, F.length(c) - F.col("start") - F.col("behind"))) for c in ("line", "kept")}
    return (parts["line"][0] == parts["kept"][0]) & (parts["line"][1] == parts["kept"][1]) & F.levenshtein(parts["line"][2], parts["kept"][2], 1).between(0, 1)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1, exact_chars: int | None = None) -> DataFrame:
    """Documents -> the same rows and columns with removed lines taken out of ``text``, and dedup_lines, dedup_removed (counts).

    Null texts stay null and count as one empty line. Rows of one doc_id share their line numbers: a line that goes from one goes from all.
    Rows with a null doc_id are one document, after all others. Documents stay even when nothing is left of them, with an empty text. Other
    columns are kept; one with the name of a count gets a ``_`` behind its name. An empty table gives an empty result.
    """
    names = spared(docs.columns, ["dedup_lines", "dedup_removed"])
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    gone = removed_lines(docs, min_chars, max_edits, exact_chars).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")).withColumnRenamed("doc_id", "gone_id")
    kept = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()]).withColumn("lines", F.split(F.coalesce(own["text"], F.lit("")), "\n"))
    out = kept.join(gone, F.col(own["doc_id"]).eqNullSafe(F.col("gone_id")), "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(numbers, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(own["text"])).otherwise(left)
    n = F.size("lines")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(n - F.size(numbers))
    return out.select(*[(text if c == "text" else F.col(k)).alias(name) for name, (c, k) in zip(names, own.items(), strict=True)], n.cast("long").alias("dedup_lines"), removed.cast("long").alias("dedup_removed"))

"""Importance resampling towards a target distribution: weights by arrays, a draw by merging sorted runs.

Hashed word runs are counted over the corpus and over the target; a bucket's gain is how much likelier the target is to have it. A document's weight is
the mean gain of its features, and its score that weight plus noise made from its id, so the highest scores are a draw without replacement.

The draw: each partition's eligible rows are written as a sorted run. Rows that can't be drawn by their score alone are left out of the runs: the counts
of each score (a bounded table) say which. The runs are cut into ranges of the order, and in each range a tournament tree merges the slices of all runs, from the
rank at which the range starts, and stops at the last rank of the draw. So no task sees all rows, and ranks come without a window over the whole table.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from emberlens.llm.batches import slices
from emberlens.shared import materialize

#: The contract of op12_resampling: words of a run at most, buckets, the seed, words of an eligible document, percent drawn.
WORDS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, "2024", 20, 10
#: Rows of a range of the merge (about), bytes of texts that are hashed at a time, words of a block, bytes up to which a word is hashed beside others. Bounds on memory and time alone.
MERGE_ROWS, SLICE, BLOCK, SHORT_WORD = 500_000, 500_000, 1 << 18, 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)  # digits, letters and whatever isn't ASCII
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC, _FULL = _crc_table(), np.uint32(0xFFFFFFFF)


def crc_on(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 registers after each one has taken in its stretch of ``raw``: one byte of all stretches at a time, long stretches on their own."""
    state, order = state.copy(), np.argsort(-sizes, kind="stable")
    own = int(np.searchsorted(-sizes[order], -SHORT_WORD, "left"))  # so many are longer
    for i in order[:own]:
        state[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]].tobytes(), int(state[i] ^ _FULL)) ^ _FULL
    order = order[own:]
    at, left, reg = starts[order], sizes[order], state[order]
    for j in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -j, "left"))  # those with more than j bytes
        reg[:m] = _CRC[(reg[:m] ^ raw[at[:m] + j]) & 255] ^ (reg[:m] >> 8)
    state[order] = reg
    return state


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in lower case (A-Z only), where words start, their sizes, and which words each text has (as cuts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = cuts[(cuts > 0) & (cuts < len(raw))]  # words end with their text
    first[edges], last[edges - 1] = inside[1:-1][edges], inside[1:-1][edges - 1]
    starts = np.flatnonzero(first)
    return _LOWER[raw], starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, cuts)


def feature_buckets(texts: pa.Array, words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (text number, bucket), one for each run of 1 to ``words`` words."""
    raw, starts, sizes, cuts = words_of(texts)
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    space = np.full(1, 0x20, np.uint8)
    for a in range(0, len(starts), BLOCK):
        b = min(len(starts), a + BLOCK)
        state = crc_on(np.full(b - a, _FULL), raw, starts[a:b], sizes[a:b])
        yield owner[a:b], (state ^ _FULL) % np.uint32(buckets)
        at = np.arange(a, b)
        for more in range(1, words):
            keep = at + more < cuts[owner[at] + 1]
            at, state = at[keep], state[keep]
            state = crc_on(state, space, np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
            state = crc_on(state, raw, starts[at + more], sizes[at + more])
            yield owner[at], (state ^ _FULL) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(text, ...) -> bucket, n: how many features of all texts fall into each bucket that has any; a task sends at most ``buckets`` rows. Null and empty texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            for _, b in feature_buckets(batch.column(0), words, buckets):
                n += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])

    return docs.select("text").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, shares smoothed by one feature a bucket."""
    s, t, k = corpus.tolist(), target.tolist(), len(corpus)
    most, aim = float(sum(s) + k), float(sum(t) + k)
    return np.array([math.floor(1000 * math.log((y + 1.0) * most / ((x + 1.0) * aim))) for x, y in zip(s, t, strict=True)], np.int64)


def noise(doc_id: int, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, words: int = WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, text, ...) -> row (unique), doc_id, n_words, n_features, weight, score; a row for each row.

    The weight is the mean of the gains over the features, rounded down, 0 without features. A null doc_id has no noise, so no score.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
            n, total = np.zeros((2, batch.num_rows), np.int64)
            single = np.zeros(batch.num_rows, np.int64)
            for k, (owner, b) in enumerate(feature_buckets(batch.column(2), words, len(gain))):
                n += np.bincount(owner, minlength=len(n))
                np.add.at(total, owner, gain[b]) if len(owner) < 64 else _add_runs(total, owner, gain[b])
                if k % words == 0:
                    single += np.bincount(owner, minlength=len(n))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = [None if i is None else w + noise(i, seed) for i, w in zip(batch.column(1).to_pylist(), weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, (single, n, weight)), pa.array(score, pa.int64())], ["row", "doc_id", "n_words", "n_features", "weight", "score"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(work, "row long, doc_id long, n_words long, n_features long, weight long, score long")


def _add_runs(total: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    """Adds the values to their owners, which come in ascending order."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    total[owner[first]] += np.add.reduceat(values, first)


class Tournament:
    """A tree of losers over sorted runs: each ``pop`` takes the least head and replays its run's matches on the way to the root."""

    END = (math.inf,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, k = [iter(r) for r in runs], [], len(runs)
        self.heads = [next(r, self.END) for r in self.runs]
        winners, self.losers = [0] * k + list(range(k)), [0] * k
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def pop(self) -> tuple:
        heads, losers, won = self.heads, self.losers, self.winner
        out = heads[won]
        heads[won] = next(self.runs[won], self.END)
        node = (len(heads) + won) >> 1
        while node:
            if heads[losers[node]] < heads[won]:
                won, losers[node] = losers[node], won
            node >>= 1
        self.winner = won
        return out


def merged(part: pa.Table, draw: int) -> pa.Table:
    """Rows (run, row, score, doc_id, place, start) of one range -> row, rank: the slices of all runs merged from the range's first rank on, no further than rank ``draw``."""
    run, row, score, doc_id, place = (part.column(c).to_numpy() for c in ("run", "row", "score", "doc_id", "place"))
    order = np.lexsort((place, run))  # fragments of a run, as the shuffle brought them, in the run's order
    cuts = [0, *(np.flatnonzero(np.diff(run[order])) + 1).tolist(), len(order)]
    keys = list(zip((-score[order]).tolist(), doc_id[order].tolist(), row[order].tolist(), strict=True))
    tree = Tournament([keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    start = part.column("start")[0].as_py()
    n = min(len(order), draw - start)
    return pa.table({"row": pa.array([tree.pop()[2] for _ in range(n)], pa.int64()), "rank": np.arange(start + 1, start + n + 1)})


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (written, as it is read several times) -> row, rank of the drawn rows: the floor(percent * N / 100) highest scores of the N eligible rows, ties to smaller doc_id, then row."""
    eligible = scores.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    # scores are floors of 1000 times logarithms of counts, so there are some hundred thousand different ones at most, whatever the input
    counts = eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("all"))
    draws = F.floor(F.lit(percent) * F.col("all") / 100)
    draw, least = counts.agg(F.max(draws), F.min(F.when(F.col("before") < draws, F.col("score")))).first()
    empty = scores.select("row", F.lit(None).cast("long").alias("rank")).where("false")
    if not draw:
        return empty

    spark = scores.sparkSession
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    runs = eligible.where(F.col("score") >= least).select("row", "score", "doc_id").sortWithinPartitions(*order)
    runs = materialize(runs.withColumn("run", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(draw) // MERGE_ROWS))
    cut = materialize(runs.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "run-ranges")
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("start"))
    asked = cut.join(F.broadcast(starts.where(F.col("start") < draw)), "part")
    return asked.groupBy("part").applyInArrow(lambda t: merged(t, int(draw)), "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents (doc_id, text, ...) and texts of the target (text, ...) -> doc_id, n_features, weight, score, rank; a row for each document.

    Features are all runs of 1 to ``words`` words of the whole text, hashed into ``buckets``; words are runs of digits, letters and non-ASCII characters, A-Z read as
    a-z. Drawn documents have ranks from 1 on by score, ties to smaller doc_id; the others have none. Null and empty texts have no features and weight 0. A null
    doc_id has no score and takes no part in the draw. Repeated rows are documents of their own, in any order among themselves. An empty table gives no
    rows, an empty target makes all buckets alike there. Other columns are ignored, whatever their names. Texts are read whole, twice.
    """

    def counted(rows: DataFrame) -> np.ndarray:
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(rows, words, buckets).collect():  # at most ``buckets`` rows
            n[r.bucket] = r.n
        return n

    scores = materialize(scored(docs, gains(counted(docs), counted(target)), words, seed), "scores")
    return scores.join(drawn(scores, percent, least_words), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")

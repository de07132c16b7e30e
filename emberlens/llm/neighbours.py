"""Nearest neighbours by a block matrix join.

Vectors are scaled to unit length and rounded to int8. Queries and candidates are dealt into groups; a cell of the matrix (a group of queries and a
group of candidates) is computed in tiles, each one int8 matrix product. Each row's rounding error, kept exactly, bounds how far a product can be from the
cosine. In a tile a pair survives when its upper bound reaches the k-th largest lower bound of its query, in the tile or so far; survivors are recomputed from
the original vectors in double precision and go into the query's heap. A cell returns k rows for each query, and the cells' heaps are merged by query. No
pair of the true k nearest is lost.

What it costs. Every query meets every candidate: the products grow with queries x candidates. What is shipped is far less, as a group is large: with
groups of GROUP_BYTES a vector is copied once for each group of the other side.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlens.shared import materialize

#: Bytes of vectors in a group at most (about: groups are dealt by hash), and rows of a tile on each side.
GROUP_BYTES, TILE = 16 << 20, 2048
#: A table that would fit a few groups is dealt into so many rows a group at least, as far as there are cores for them.
LEAST_ROWS = 1024


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times a power of two so that its largest component is near 1: exact, and no square overflows or vanishes."""
    exact = vectors.astype(np.float64)
    return np.ldexp(exact, -np.frexp(np.abs(exact).max(1, keepdims=True))[1])


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled rows -> int8 codes, their scales, and the length of each unit vector's rounding error."""
    unit = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of scaled rows, in double precision, summed from the first component to the last: equal vectors give equal scores in any group."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Heaps:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.best, self.floor = k, [[] for _ in range(n)], np.full(n, -np.inf)

    def add(self, row: int, score: float, vec_id: int) -> None:
        heap, item = self.best[row], (score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.floor[row] = heap[0][0]


def tile(queries: tuple, candidates: tuple, heaps: Heaps, at: int) -> int:
    """Compares two tiles of (ids, scaled rows, codes, scales, errors), fills the heaps of the queries from ``at`` on, and says how many pairs it recomputed."""
    (qid, q, qc, qs, qe), (cid, c, cc, cs, ce) = queries, candidates
    # products of int8 codes sum to whole numbers below 2**24 for up to 1040 components, so float32 holds them exactly
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    near = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = qe[:, None] + ce[None, :] + qe[:, None] * ce[None, :] + 1e-9
    near[qid[:, None] == cid[None, :]] = -np.inf
    floor = heaps.floor[at : at + len(qid)] - 1e-12
    if near.shape[1] > heaps.k:
        floor = np.maximum(floor, np.partition(near - slack, -heaps.k, axis=1)[:, -heaps.k])
    rows, cols = np.nonzero((near + slack >= floor[:, None]) & (near > -np.inf))
    for row, vec_id, score in zip(rows.tolist(), cid[cols].tolist(), cosine(q[rows], c[cols]).tolist(), strict=True):
        if not np.isfinite(score):
            raise ValueError("a score is not finite")
        heaps.add(at + row, score, vec_id)
    return len(rows)


def _tiles(group: pa.Table) -> list[tuple]:
    ids, vectors = group.column("vec_id").to_numpy(), group.column("embedding").combine_chunks()
    rows = scaled(vectors.values.to_numpy()[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(len(ids), -1)) if len(ids) else np.zeros((0, 1))
    return [(ids[i : i + TILE], r := rows[i : i + TILE], *quantise(r)) for i in range(0, len(ids), TILE)]


def search_cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k nearest of each query among the candidates of one cell."""
    asked, held = _tiles(queries), _tiles(candidates)
    heaps, at = Heaps(queries.num_rows, k), 0
    for q in asked:
        for c in held:
            tile(q, c, heaps, at)
        at += len(q[0])
    ids = queries.column("vec_id").to_pylist()
    found = [(q, -c, s) for q, heap in zip(ids, heaps.best, strict=True) for s, c in heap]
    q, c, s = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})


def nearest(vectors: DataFrame, queries: Column, k: int = 5, group_bytes: int = GROUP_BYTES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(vec_id, embedding array<float or double>, ...) -> query_id, rank (from 1), vec_id, score: the k nearest by cosine of every vector for which ``queries`` holds.

    Exact, ties to the smaller vec_id; all candidates where there are fewer than k. Null vectors and ids, zero vectors and ones with null or
    non-finite components take no part. Vectors meet only vectors of their own length. Rows with one vec_id are one vector (the least
    of them); other columns are ignored; empty tables give no rows.
    """
    clean = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    clean = materialize(clean.withColumn("dim", F.size("embedding")), "vectors")
    width = clean.schema["embedding"].dataType.elementType.simpleString() == "double" and 8 or 4
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    room = F.greatest(F.lit(1), F.floor(F.lit(group_bytes) / (F.col("dim") * width)))

    def groups(n: str) -> Column:
        """By memory; more of them while the groups stay large and cores are free."""
        return F.greatest(F.lit(1), F.ceil(F.col(n) / room), F.least(F.lit(cores), F.floor(F.col(n) / least_rows))).cast("int")

    parts = clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(queries, 1)).alias("asked")).where("asked > 0")
    parts = materialize(parts.select("dim", groups("n").alias("columns"), F.greatest(F.lit(1), F.ceil(F.col("asked") / room)).cast("int").alias("rows")), "vector-groups")

    def dealt(df: DataFrame, own: str, others: str, names: list[str]) -> DataFrame:
        # dealt by hash: equal vectors don't meet in one group, as their ids differ
        placed = df.join(parts, "dim").withColumn(names[0], F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        return placed.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select(*[F.col(c).alias(c) for c in ("dim", "row", "column", "vec_id", "embedding")])

    asked = dealt(clean.where(queries), "rows", "columns", ["row", "column"]).groupBy("dim", "row", "column")
    held = dealt(clean, "columns", "rows", ["column", "row"]).groupBy("dim", "row", "column")
    found = asked.cogroup(held).applyInArrow(lambda q, c: search_cell(q, c, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))

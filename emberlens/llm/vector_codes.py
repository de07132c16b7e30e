"""Vector codes by Lloyd's rounds with Hamerly's bounds, in whole numbers.

Vectors become integers and are cut into parts; each part position has a codebook. Every part keeps its entry, an upper bound of its distance to it and a
lower bound of its distance to any other entry. When entries move, the bounds widen by what they moved, and only a part whose upper bound isn't strictly below
its lower one measures its distance, and only if that isn't strictly below either compares all entries. Bounds are whole numbers rounded outwards, so a part that is
skipped has its entry strictly nearest, and ties always meet the full scan, which takes the lower index.

A round is one pass: tasks read the table of the round before, assign, and write rows and bounds anew; each task's last row has its sums by part and
entry. Those few numbers make the next codebooks. The driver has codebooks alone (entries x dimensions numbers), and each round starts from a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlens.llm.sieve import COMMON, join_common
from emberlens.shared import discard, materialize

#: The contract of op13_vector_codes: units of a component, parts of a vector, entries of a codebook, rounds.
UNIT, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are compared at a time. A bound on memory alone.
BLOCK = 4096
STATE = "vec_id long, label_key string, ints array<long>, entry array<short>, upper array<long>, lower array<long>, error long, sums array<long>, full long"


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def root_up(squares: np.ndarray) -> np.ndarray:
    """The least whole numbers whose squares are at least these."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= (r > 0) & (r * r >= squares)
    r += r * r < squares
    return r + (r * r < squares)


def root_down(squares: np.ndarray) -> np.ndarray:
    """The largest whole numbers whose squares are at most these."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64) + 1
    r -= r * r > squares
    return r - (r * r > squares)


def distances(rows: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, width) to entries (k, width), exact."""
    out = np.zeros((len(rows), len(books)), np.int64)
    for j in range(rows.shape[1]):
        out += (rows[:, j, None] - books[None, :, j]) ** 2
    return out


FAR = np.int64(1) << 62


def full_scan(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries (ties to the lower index), upper bounds, and lower bounds for all other entries."""
    d = distances(rows, books)
    near = d.argmin(1)
    at = np.arange(len(rows))
    best = d[at, near].copy()
    d[at, near] = FAR
    return near, root_up(best), np.where(d.min(1) == FAR, FAR, root_down(np.minimum(d.min(1), FAR - 1)))


def assign(rows: np.ndarray, books: np.ndarray, moved: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One part position of a block: the new entries and bounds after the entries moved by at most ``moved``, and how many parts compared all entries."""
    entry, upper = entry.copy(), upper + moved[entry]
    most = np.sort(moved)[-2:]
    others = np.where(moved[entry] == most[-1], most[0], most[-1]) if len(moved) > 1 else np.zeros(len(entry), np.int64)
    lower = np.maximum(lower - others, 0)
    open_ = np.flatnonzero(upper >= lower)
    upper[open_] = root_up(((rows[open_] - books[entry[open_]]) ** 2).sum(1))
    open_ = open_[upper[open_] >= lower[open_]]
    if len(open_):
        entry[open_], upper[open_], lower[open_] = full_scan(rows[open_], books)
    return entry, upper, lower, len(open_)


def _matrix(column: pa.ListArray, kind) -> np.ndarray:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return flat[offsets[0] : offsets[-1]].astype(kind).reshape(len(column), -1)


def _nested(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.reshape(-1)).cast(kind))


def _pass(batches: Iterator[pa.RecordBatch], books: np.ndarray, moved: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Assigns the rows of a task. ``books``: (parts, entries, width). Without ``moved`` there are no bounds yet. The last row has the sums."""
    parts, entries, width = books.shape
    sums, full = np.zeros((parts, entries, 1 + width), np.int64), 0
    schema = pa.schema([("vec_id", pa.int64()), ("label_key", pa.string()), ("ints", pa.list_(pa.int64())), ("entry", pa.list_(pa.int16())), ("upper", pa.list_(pa.int64())), ("lower", pa.list_(pa.int64())), ("error", pa.int64()), ("sums", pa.list_(pa.int64())), ("full", pa.int64())])
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            ints = _matrix(batch.column(2), np.int64)
            entry = np.zeros((len(ints), parts), np.int64) if moved is None else _matrix(batch.column(3), np.int64)
            upper, lower = (np.zeros((len(ints), parts), np.int64) if moved is None else _matrix(batch.column(c), np.int64) for c in (4, 5))
            error = np.zeros(len(ints), np.int64)
            for p in range(parts):
                rows = ints[:, p * width : (p + 1) * width]
                if moved is None:
                    entry[:, p], upper[:, p], lower[:, p] = full_scan(rows, books[p])
                    full += len(rows)
                else:
                    entry[:, p], upper[:, p], lower[:, p], n = assign(rows, books[p], moved[p], entry[:, p], upper[:, p], lower[:, p])
                    full += n
                error += ((rows - books[p][entry[:, p]]) ** 2).sum(1)
                sums[p, :, 0] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(sums[p, :, 1:], entry[:, p], rows)
            none = pa.nulls(len(ints), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _nested(entry, pa.int16()), _nested(upper, pa.int64()), _nested(lower, pa.int64()), pa.array(error), none, pa.nulls(len(ints), pa.int64())], schema=schema)
    if sums[0, :, 0].any():
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:7]), _nested(sums.reshape(1, -1), pa.int64()), pa.array([full])], schema=schema)


def _next_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries moved to their parts' means, rounded down; unused ones stay."""
    added = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
    for r in added.collect():  # parts x entries x (1 + width) numbers
        total[r.at] = r.n
    total = total.reshape(books.shape[0], books.shape[1], -1)
    return np.where(total[:, :, :1] > 0, total[:, :, 1:] // np.maximum(total[:, :, :1], 1), books)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, unit: int = UNIT, label: str = "label") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, embedding, label, ...) -> the written table of the last assignment (rows, and one with sums for each task), the final codebooks (parts, entries,
    width), and how many parts compared all entries in each assignment."""
    clean = vectors.where(usable(F.col("embedding")))
    key = F.when(F.col(label).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * unit).cast("double"))
    first = clean.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(1).collect()
    none: DataFrame = vectors.sparkSession.createDataFrame([], STATE)
    if not first:
        return none, np.zeros((parts, 0, 0), np.int64), []
    dim = len(first[0].embedding)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = clean.where(F.size("embedding") == dim).select("vec_id", key.alias("label_key"), ints.alias("x"))
    # within this bound every squared distance of a vector, and so every error, is a long
    bound = float(int(np.sqrt(2.0**62 / dim) / 2))
    fits = F.when(F.array_max(F.transform("x", F.abs)) <= bound, F.col("x").cast("array<long>")).otherwise(F.raise_error(F.lit(f"a component is beyond {bound / unit}")))
    lists = {c.split()[0]: c.split()[1] for c in STATE.split(", ")}
    state = materialize(rows.select("vec_id", "label_key", fits.alias("ints"), *[F.lit(None).cast(lists[c]).alias(c) for c in list(lists)[3:]]), "vectors")
    seeds = state.select("vec_id", "ints").orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    books = np.stack([np.array(s.ints, np.int64).reshape(parts, -1) for s in seeds], 1)
    moved, scans = None, []
    for k in range(rounds + 1):
        done = materialize(state.where("ints IS NOT NULL").mapInArrow(lambda b, books=books, moved=moved: _pass(b, books, moved), STATE), "vector-codes")
        discard(state)
        state = done
        scans.append(state.agg(F.sum("full")).first()[0])
        if k < rounds:
            fresh = _next_books(state, books)
            moved, books = root_up(((fresh - books) ** 2).sum(2)), fresh
    return state, books, scans


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, unit: int = UNIT, label: str = "label") -> DataFrame:
    """(vec_id, embedding array<float or double>, label, ...) -> vec_id, code, error, label_error, codebooks_sha256: a row for each row that can be coded.

    Components become floor(unit * x); a vector is cut into ``parts`` equal parts. Each part position's codebook starts as that part of the ``entries`` smallest vec_ids
    (fewer vectors, fewer entries); each of ``rounds`` rounds assigns parts to the nearest entry, ties to the lower index, then moves the entries to
    the means, rounded down; parts are assigned once more at the end. code: an index in two hex digits for each part. error: squared distances summed over the
    parts; label_error: errors summed over equal labels, null labels together. Rows without a vector, and with null or non-finite components, are dropped, as are
    vectors whose length isn't that of the smallest vec_id's. A null vec_id stands last. Repeated rows are rows of their own; equal vectors get
    equal codes. Components so large that an error wouldn't be a long raise an error. Other columns are ignored; an empty table gives no rows.
    """
    state, books, _ = fit(vectors, parts, entries, rounds, unit, label)
    spelled = ",".join(map(str, books.reshape(-1).tolist()))
    rows = state.where("ints IS NOT NULL").select("vec_id", "label_key", "error", F.array_join(F.transform("entry", lambda e: F.lpad(F.lower(F.hex(e.cast("long"))), 2, "0")), "").alias("code"))
    labels = materialize(rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows_of")), "label-errors")
    common = labels.where(F.col("rows_of") >= COMMON).select(F.xxhash64("label_key").alias("h"))
    out = join_common(rows.withColumn("h", F.xxhash64("label_key")), labels.select("label_key", "label_error"), "label_key", common)
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(spelled.encode()).hexdigest()).alias("codebooks_sha256"))

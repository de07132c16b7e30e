"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover the whole text. Learned filters slide over each chunk's bytes; each
filter's largest response in a chunk is kept (max-pooling), the chunks' pooled responses are averaged, and a logistic unit turns
them into one probability. Filters see one-hot bytes, so a response is a sum of table rows, one for each byte under the filter.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberlens.llm.names import spared

#: Bytes under a filter, filters, bytes in a chunk. Chunks overlap by WIDTH - 1 bytes, so every window of the text lies in one of them.
WIDTH, FILTERS, CHUNK = 6, 12, 512
#: Training takes at most so many labelled rows of each class, and none whose text is longer than so many bytes.
MAX_ROWS_PER_CLASS, MAX_TRAIN_BYTES = 600, 16_384
EPOCHS, RATE, SEED = 30, 0.02, 7
PAD = 0


@dataclass
class Network:
    """tables: (WIDTH, 256, FILTERS) filter weights; shift: (FILTERS,); out: (FILTERS,); bias."""

    tables: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float

    def pairs(self) -> np.ndarray:
        """Tables of two neighbouring bytes at once: half the look-ups."""
        t = self.tables
        return np.stack([(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(t), 2)])


def _windows(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return raw if len(raw) >= WIDTH else np.concatenate([raw, np.full(WIDTH - len(raw), PAD, np.uint8)])


def _pooled(data: bytes, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk (chunks, FILTERS), where it is, and the bytes."""
    raw = _windows(data)
    two = raw[:-1].astype(np.int32) * 256 + raw[1:]
    n = len(raw) - WIDTH + 1  # windows
    best, at = [], []
    for start in range(0, n, CHUNK * 64):  # bounded memory for any length
        stop = min(n, start + CHUNK * 64)
        r = pairs[0][two[start:stop]]
        for k in range(1, len(pairs)):
            r += pairs[k][two[start + 2 * k : stop + 2 * k]]
        full = (stop - start) // CHUNK * CHUNK
        if full:
            cut = r[:full].reshape(-1, CHUNK, r.shape[1])
            where = cut.argmax(1)
            best.append(np.take_along_axis(cut, where[:, None], 1)[:, 0])
            at.append(where + start + np.arange(0, full, CHUNK)[:, None])
        if full < stop - start:
            where = r[full:].argmax(0)
            best.append(r[full:][where, np.arange(r.shape[1])][None])
            at.append((where + start + full)[None])
    return np.concatenate(best), np.concatenate(at), raw


def _logit(pooled: np.ndarray, net: Network) -> tuple[float, np.ndarray]:
    held = np.maximum(pooled + net.shift, 0)
    features = held.mean(0, dtype=np.float64)
    return float(features @ net.out + net.bias), features


def score(data: bytes, net: Network, pairs: np.ndarray) -> float:
    z, _ = _logit(_pooled(data, pairs)[0], net)
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the cross-entropy, both classes weighing the same. One class or no rows: a network that says 0.5 or that class."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.choice([-1.0, 1.0], FILTERS), 0.0)
    if len(set(labels)) < 2:
        net.out[:], net.bias = 0, 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return net
    share = np.mean(labels)
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    parts = [net.tables, net.shift, net.out]
    m, v = [np.zeros_like(p) for p in parts] + [0.0], [np.zeros_like(p) for p in parts] + [0.0]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 32)):
            grads = [np.zeros_like(p) for p in parts] + [0.0]
            pairs = net.pairs()
            for i in batch:
                pooled, at, raw = _pooled(texts[i], pairs)
                z, features = _logit(pooled, net)
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[i]) * weight[labels[i]] / len(batch)
                grads[2] += d * features
                grads[3] += d
                back = (pooled + net.shift > 0) * (d * net.out / len(pooled)).astype(np.float32)
                grads[1] += back.sum(0)
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (raw[at + k], np.arange(FILTERS)[None]), back)
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                move = RATE * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-7)
                if j < 3:
                    parts[j] -= move.astype(parts[j].dtype)
                else:
                    net.bias -= float(move)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1. Null ids are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows_per_class: int = MAX_ROWS_PER_CLASS, max_bytes: int = MAX_TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """A bounded, repeatable sample: of each class the rows with the smallest hashes of their ids."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    rank = F.xxhash64("doc_id")
    few = known.where("quality = 0").orderBy(rank, "doc_id").limit(max_rows_per_class).union(known.where("quality = 1").orderBy(rank, "doc_id").limit(max_rows_per_class))
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    # at most 2 * max_rows_per_class rows: of rows that repeat one doc_id the one with the least text is taken
    rows = short.join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.text))
    return [(r.text.encode(), r.quality) for r in rows]


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """Documents -> the same rows and columns and quality_score (0 to 1, higher: better).

    Every byte of every text is read, however long; a null text is an empty one, and an empty one has the score of six zero bytes. Only
    the text decides the score, so equal texts score alike. Repeated rows stay; empty tables give empty results. Other columns are kept;
    one named quality_score gets a ``_`` behind its name.
    """
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    names = spared(docs.columns, ["quality_score"])

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs = net.pairs()
        for texts in batches:  # one text at a time becomes a Python object
            yield pa.array([score(t.as_buffer().to_pybytes() if t.is_valid else b"", net, pairs) for t in texts], pa.float64())

    kept = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()])
    out = kept.withColumn("quality_score", scored(F.coalesce(own["text"], F.lit(""))))
    return out.select(*[F.col(k).alias(name) for name, k in zip(names, own.values(), strict=True)], "quality_score")

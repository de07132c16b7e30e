"""Media columns: content-addressed payloads in tar shards.

A task writes its payloads, as 8-bit grey PNG images 64 pixels wide, into one tar shard in the shared folder; a member's name is the
SHA-256 of its bytes, and no payload is stored twice. Rows carry digest, shard, offset and length. Metadata columns are filled by range reads of the images' headers
alone; pixels are read only where a feature needs them.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from emberlens.llm.sieve import COMMON, join_common, marked, sieve
from emberlens.shared import materialize, scratch_path, shared_folder

SIDE = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk.
HEADER_BYTES = 33
LEVEL = 6
#: Bytes of stored images that a reading task gets, and that stand together in it.
TASK_BYTES, STRETCH = 16 << 20, 1 << 17


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode()
    return raw + bytes((-len(raw)) % SIDE or (0 if raw else SIDE)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """Payload -> PNG; one sample for each byte. The unpadded length stands in a tEXt chunk behind the header."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()  # filter type 0 before each line
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict:
    if len(head) < HEADER_BYTES or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode(stored: bytes) -> tuple[bytes, int]:
    """PNG -> payload and its unpadded length; raises on damage."""
    height = read_header(stored[:HEADER_BYTES])["height"]
    at, data, n = 8, [], None
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt":
            n = int(body.split(b"\0")[1])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, SIDE + 1)
    return lines[:, 1:].tobytes(), n


def feature_of(payload: bytes) -> str:
    """Rows, the share of each sixteenth of the byte range (per mille), and an 8 x 8 average hash of the picture."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    counts = np.bincount(pixels.reshape(-1) >> 4, minlength=16)
    bands = np.add.reduceat(pixels.sum(0, dtype=np.int64), np.arange(0, SIDE, 8))
    cuts = np.linspace(0, len(pixels), 9).astype(int)
    tiles = np.array([[pixels[a : max(b, a + 1), 8 * j : 8 * j + 8].sum(dtype=np.int64) * 1000 // (8 * max(b - a, 1)) for j in range(8)] for a, b in zip(np.minimum(cuts[:-1], len(pixels) - 1), cuts[1:], strict=True)])
    bits = (tiles.reshape(-1) * 64 > tiles.sum()).astype(np.uint8)
    return f"{len(pixels)};{','.join(str(int(c) * 1000 // pixels.size) for c in counts)};{np.packbits(bits).tobytes().hex()};{int(bands.argmax())}"


def store_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, digest, shard, offset, length: an index table, one row for each document.

    Runs at once. A null text is an empty one. Equal payloads are stored once over all shards: texts that stand in one row are written by the
    task that reads them; of those that a sieve of the repeated ones lets through, each task keeps one copy, and one of these is written.
    A shard's name is new for each attempt of a task and only a finished task's rows reach the index, so lost or repeated tasks leave at
    most shards that no row names. Other columns are ignored, repeated rows get a row each, an empty table gives an empty index.
    """
    folder = scratch_path(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        shard = f"{path}/{uuid.uuid4().hex}.tar"
        with store.open_output_stream(shard) as out:
            at = 0
            while batch is not None:
                rows = []
                for text in batch.column(1).to_pylist():
                    media = encode(*payload_of(text))
                    info = tarfile.TarInfo(hashlib.sha256(media).hexdigest())
                    info.size = len(media)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    out.write(head + media + bytes(-len(media) % 512))
                    rows.append((info.name, at + len(head), len(media)))
                    at += len(head) + len(media) + -len(media) % 512
                digests, offsets, lengths = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array([shard] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "digest", "shard", "offset", "length"])
                batch = next(batches, None)
            out.write(bytes(1024))

    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key")).withColumn("h", F.xxhash64("key"))
    keys = materialize(keyed.select("doc_id", "key", "h"), "media-keys")
    counts = materialize(keys.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "media-copies")
    seen = marked(keyed.select("key", "text", "h"), "h", sieve(counts, "h"), "again")
    once = seen.where("again").groupBy("key").agg(F.first("text").alias("text"))
    texts = seen.where("NOT again").select("key", "text").union(once)
    stored = materialize(texts.mapInArrow(write, "key binary, digest string, shard string, offset long, length long"), "media-stored")
    index = join_common(keys, stored, "key", counts.where(F.col("n") > COMMON).select("h"))
    return materialize(index.select("doc_id", "digest", "shard", "offset", "length"), "media-index")


def members(index: DataFrame) -> DataFrame:
    """digest, shard, offset, length: a row for each stored payload."""
    return index.select("digest", "shard", "offset", "length").distinct()


def _ranges(rows: DataFrame, columns: dict[str, str], size, fill) -> DataFrame:
    """(shard, offset, length, ...) -> the rows and what ``fill`` makes of the first ``size``(length) bytes of each.

    Rows are dealt by stretches of their shards, in as many tasks as their bytes need, and read in the order of the shards. Columns
    named as the new ones, and none else, are replaced.
    """
    kept = [c for c in rows.columns if c not in columns]
    folder, names = shared_folder(rows.sparkSession), list(columns)
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # one number
    dealt = rows.select(*kept).repartition(-(-total // TASK_BYTES) or 1, "shard", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("shard", "offset")
    shard_at, offset_at, length_at = (kept.index(c) for c in ("shard", "offset", "length"))
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t] for t in columns.values()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        open_shard, handle = None, None
        for batch in batches:
            made: list[list] = [[] for _ in names]
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (shard_at, offset_at, length_at)), strict=True):
                if shard != open_shard:
                    open_shard, handle = shard, store.open_input_file(shard)
                for out, value in zip(made, fill(handle.read_at(size(length), offset)), strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m, t) for m, t in zip(made, types, strict=True)]], [*batch.schema.names, *names])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields), *(f"`{c}` {t}" for c, t in columns.items())])
    return dealt.mapInArrow(read, kinds)


def add_metadata(rows: DataFrame) -> DataFrame:
    """(shard, offset, length, ...) -> the rows and width, height, bit_depth, header_bytes (bytes read for them: 33 of each image at most)."""

    def fill(head: bytes) -> tuple:
        h = read_header(head)
        return h["width"], h["height"], h["bit_depth"], len(head)

    return _ranges(rows, {"width": "int", "height": "int", "bit_depth": "int", "header_bytes": "int"}, lambda length: min(length, HEADER_BYTES), fill)


def add_contents(rows: DataFrame) -> DataFrame:
    """(shard, offset, length, ...) -> the rows and what the stored bytes give: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def fill(stored: bytes) -> tuple:
        payload, n = decode(stored)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SIDE:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)

    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return _ranges(rows, kinds, lambda length: length, fill)


def describe(index: DataFrame) -> DataFrame:
    """An index -> a row for each document with its digest and the columns of ``add_metadata`` and ``add_contents``; each stored payload is read once."""
    read = add_contents(add_metadata(members(index))).drop("shard", "offset", "length")
    keys = index.select("doc_id", "digest").withColumn("h", F.xxhash64("digest"))
    counts = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("h")
    return join_common(keys, read, "digest", materialize(counts, "media-common")).drop("h")

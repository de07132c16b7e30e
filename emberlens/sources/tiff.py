"""Windows of tiled TIFF files as rows of pixels, by range reads: directories first, then only the tiles that a window meets.

A row asks for a window of a level of a file; its directory is read by a few ranges and becomes a row for each tile in the window, which any task can read and decode. Files
lie in any store that pyarrow opens by its address (file, hdfs, s3, gs). Classic and big TIFF, either byte order, one sample a pixel, without compression or
deflated, with or without horizontal differences.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

# Tags of a TIFF directory, sizes and letters of its field types, and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, FORMAT = 256, 257, 258, 259, 277, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT = 33550, 33922
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
PLAIN, DEFLATE = (1,), (8, 32946)
#: Bytes of a first read, which mostly holds the directories.
HEAD = 16_384


class Ranges:
    """A file of which only ranges are read; the first bytes are kept."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()
        self.head = self.file.read_at(min(HEAD, self.size), 0)
        self.read_bytes = len(self.head)

    def at(self, start: int, n: int) -> bytes:
        if start + n <= len(self.head):
            return self.head[start : start + n]
        if start + n > self.size:
            raise ValueError("the file ends before its contents")
        self.read_bytes += n
        return self.file.read_at(n, start)


def directories(source: Ranges) -> tuple[str, list[dict[int, tuple]]]:
    """The byte order ('<' or '>') and the tags of each directory: the image and its overviews."""
    mark, magic = source.at(0, 2), source.at(2, 2)
    if mark not in (b"II", b"MM"):
        raise ValueError("no TIFF file")
    order = "<" if mark == b"II" else ">"
    version = struct.unpack(order + "H", magic)[0]
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    word, entry, many = ("Q", 20, "Q") if big else ("I", 12, "H")
    wide, few = struct.calcsize("<" + word), struct.calcsize("<" + many)
    at = struct.unpack(order + word, source.at(8 if big else 4, wide))[0]
    out: list[dict[int, tuple]] = []
    while at and len(out) < 64:
        n = struct.unpack(order + many, source.at(at, few))[0]
        body, tags = source.at(at + few, n * entry + wide), {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", body, i * entry)
            count = struct.unpack_from(order + word, body, i * entry + 4)[0]
            if kind not in FIELDS:
                continue
            letter = FIELDS[kind]
            size = struct.calcsize("<" + letter) * count
            place = i * entry + 4 + wide
            data = body[place : place + size] if size <= wide else source.at(struct.unpack_from(order + word, body, place)[0], size)
            tags[tag] = (data,) if letter == "s" else struct.unpack(order + letter * count if len(letter) == 1 else f"{order}{2 * count}I", data)
        out.append(tags)
        at = struct.unpack_from(order + word, body, n * entry)[0]
    return order, out


def _layout(tags: dict[int, tuple]) -> tuple[int, int, int, int, np.dtype, int, int]:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    kind = KINDS.get((one(FORMAT, 1), one(BITS, 1)))
    if one(SAMPLES, 1) != 1 or kind is None or TILE_WIDTH not in tags or one(COMPRESSION, 1) not in (*PLAIN, *DEFLATE) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("the file isn't laid out in tiles of one plain or deflated sample")
    return one(WIDTH), one(HEIGHT), one(TILE_WIDTH), one(TILE_HEIGHT), np.dtype(kind), one(COMPRESSION, 1), one(PREDICTOR, 1)


TILES = "image string, path string, level int, order string, kind string, compression int, predictor int, tile_width int, tile_height int, offset long, bytes long, left long, top long, x0 long, y0 long, x1 long, y1 long"


def plan_tiles(windows: DataFrame) -> DataFrame:
    """(image, path, level, x0, y0, x1, y1; ends exclusive) -> a row for each tile that a window meets: where its bytes are and which pixels of it are asked for.

    Level 0 is full resolution. Windows are cut to the image; one outside it gives no rows, nor does a null window. A level that the file doesn't have is an error, as is a
    file of another layout. A file's directory is read once for each of its windows, by ranges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, path, level, *window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if None in (path, level, *window):
                    continue
                order, levels = directories(Ranges(path))
                if not 0 <= level < len(levels):
                    raise ValueError(f"{path} has no level {level}")
                tags = levels[level]
                width, height, tw, th, kind, compression, predictor = _layout(tags)
                x0, y0, x1, y1 = max(0, window[0]), max(0, window[1]), min(width, window[2]), min(height, window[3])
                across = -(-width // tw)
                for r in range(y0 // th, -(-y1 // th)) if y1 > y0 and x1 > x0 else ():
                    for c in range(x0 // tw, -(-x1 // tw)):
                        k = r * across + c
                        rows.append((image, path, level, order, kind.str[1:], compression, predictor, tw, th, tags[OFFSETS][k], tags[COUNTS][k], c * tw, r * th, x0, y0, x1, y1))
            names = [x.split()[0] for x in TILES.split(", ")]
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[x.split()[1]]) for x, v in zip(TILES.split(", "), columns, strict=True)], names)

    asked = windows.select("image", "path", F.col("level").cast("int"), *[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")])
    return asked.mapInArrow(work, TILES)


def read_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles -> image, level, col, row, value (double): the asked for pixels. Each tile is read by one range and decoded on its own, so tiles are dealt to all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                order = t["order"]
                if t["bytes"]:
                    store, name = fs.FileSystem.from_uri(t["path"]) if "://" in t["path"] or t["path"].startswith("file:") else (fs.LocalFileSystem(), t["path"])
                    with store.open_input_file(name) as f:
                        data = f.read_at(t["bytes"], t["offset"])
                    data = zlib.decompress(data) if t["compression"] in DEFLATE else data
                    grid = np.frombuffer(data, np.dtype(order + t["kind"])).reshape(t["tile_height"], t["tile_width"])
                    if t["predictor"] == 2:
                        grid = np.cumsum(grid.astype(grid.dtype.newbyteorder("=")), 1, dtype=grid.dtype.newbyteorder("="))
                else:  # a tile that was never written
                    grid = np.zeros((t["tile_height"], t["tile_width"]))
                rows = np.arange(max(t["y0"], t["top"]), min(t["y1"], t["top"] + t["tile_height"]))
                cols = np.arange(max(t["x0"], t["left"]), min(t["x1"], t["left"] + t["tile_width"]))
                value = grid[rows[0] - t["top"] : rows[-1] - t["top"] + 1, cols[0] - t["left"] : cols[-1] - t["left"] + 1].astype(np.float64)
                n = value.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t["image"]] * n, pa.string()), pa.array(np.full(n, t["level"], np.int32)), pa.array(np.tile(cols, len(rows))), pa.array(np.repeat(rows, len(cols))), pa.array(value.reshape(-1))],
                    ["image", "level", "col", "row", "value"],
                )

    dealt = tiles.repartition(F.xxhash64("path", "offset", "image", "x0", "y0"))
    return dealt.mapInArrow(work, "image string, level int, col long, row long, value double")


def read_windows(windows: DataFrame) -> DataFrame:
    """(image, path, level, x0, y0, x1, y1) -> image, level, col, row, value: all pixels of the windows, 0 included."""
    return read_tiles(plan_tiles(windows))


def encode(levels: list[np.ndarray], tile: int = 256, deflate: bool = True, predictor: int = 2, order: str = "<", scale: tuple[float, float] | None = None, corner: tuple[float, float] | None = None) -> bytes:
    """A classic TIFF of an image and its overviews in square tiles. With ``scale`` and ``corner`` the image says where it lies."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4  # where the place of the next directory is to be written
    for k, grid in enumerate(levels):
        height, width = grid.shape
        kind = next(x for x, v in KINDS.items() if v == grid.dtype.str[1:])
        places, sizes = [], []
        for top in range(0, height, tile):
            for left in range(0, width, tile):
                part = np.zeros((tile, tile), grid.dtype)
                cut = grid[top : top + tile, left : left + tile]
                part[: cut.shape[0], : cut.shape[1]] = cut
                if predictor == 2:
                    part[:, 1:] -= part[:, :-1].copy()
                data = part.astype(grid.dtype.newbyteorder(order)).tobytes()
                data = zlib.compress(data) if deflate else data
                places.append(len(out))
                sizes.append(len(data))
                out += data
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [kind[1]]), (COMPRESSION, 3, [8 if deflate else 1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (OFFSETS, 4, places), (COUNTS, 4, sizes), (FORMAT, 3, [kind[0]])]
        if k == 0 and scale and corner:
            tags += [(PIXEL_SCALE, 12, [*scale, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, *corner, 0.0])]
        entries = b""
        for tag, field, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{FIELDS[field]}", *values)
            if len(data) > 4:
                place = struct.pack(order + "I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, field, len(values)) + place
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0)
    return bytes(out)

"""Round trips of tiled rasters: written, windows of them read by ranges."""

import numpy as np
import pytest

from emberlens.sources import tiff

WINDOWS = "image string, path string, level int, x0 long, y0 long, x1 long, y1 long"


@pytest.mark.parametrize(("kind", "tile", "deflate", "predictor", "order"), [("u2", 16, True, 2, "<"), ("u1", 32, True, 1, ">"), ("i2", 16, False, 1, "<"), ("f4", 16, True, 1, ">"), ("u2", 64, False, 2, ">")])
def test_windows(spark, tmp_path, kind, tile, deflate, predictor, order):
    rng = np.random.default_rng(3)
    full = rng.integers(0, 120, (70, 53)).astype(kind)
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(tiff.encode([full, full[::2, ::2].copy()], tile, deflate, predictor, order, (10.0, 10.0), (300000.0, 6000000.0)))
    asks = [("all", 0, 0, 0, 53, 70), ("one", 0, 16, 16, 17, 17), ("over", 0, 40, 60, 999, 999), ("low", 1, -5, -5, 20, 9), ("none", 0, 60, 0, 70, 10), ("empty", 0, 5, 5, 5, 9)]
    df = spark.createDataFrame([(n, path if n != "low" else f"file://{path}", *w) for n, *w in asks] + [("null", None, 0, 0, 0, 1, 1)], WINDOWS)
    got = {}
    for r in tiff.read_windows(df).collect():
        assert (r.image, r.col, r.row) not in got
        got[r.image, r.col, r.row] = r.value
    want = {}
    for n, level, x0, y0, x1, y1 in asks:
        grid = full if level == 0 else full[::2, ::2]
        for y in range(max(0, y0), min(grid.shape[0], y1)):
            for x in range(max(0, x0), min(grid.shape[1], x1)):
                want[n, x, y] = float(grid[y, x])
    assert got == want
    _, levels = tiff.directories(tiff.Ranges(path))
    assert len(levels) == 2 and levels[0][tiff.PIXEL_SCALE][:2] == (10.0, 10.0) and levels[0][tiff.TIE_POINT][3:5] == (300000.0, 6000000.0)


def test_only_tiles_in_the_window_are_read(spark, tmp_path):
    grid = np.random.default_rng(1).integers(0, 60000, (2048, 2048)).astype("u2")
    (tmp_path / "big.tif").write_bytes(tiff.encode([grid], 128))
    df = spark.createDataFrame([("w", str(tmp_path / "big.tif"), 0, 300, 300, 400, 310)], WINDOWS)
    tiles = tiff.plan_tiles(df).collect()
    assert {(t.left, t.top) for t in tiles} == {(256, 256), (384, 256)} and sum(t.bytes for t in tiles) < 80_000
    assert tiff.read_tiles(tiff.plan_tiles(df)).count() == 1000
    source = tiff.Ranges(str(tmp_path / "big.tif"))
    tiff.directories(source)
    assert source.read_bytes < 30_000 < source.size


def test_other_files_are_refused(spark, tmp_path):
    ok = tiff.encode([np.zeros((4, 4), "u1")], 16)
    for name, data, why in (("a", b"GIF89a......", "no TIFF"), ("b", ok[:30], "ends before"), ("c", ok, "no level 3")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=why):
            tiff.read_windows(spark.createDataFrame([("x", str(tmp_path / name), 3, 0, 0, 1, 1)], WINDOWS)).collect()

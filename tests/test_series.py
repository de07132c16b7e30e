"""Polygon masks against a test of each pixel, candidates read one after another, and index comparisons."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlens.operators import raster, series

RING = "key long, ring array<struct<x: double, y: double>>, width long, height long"


def inside(x, y, ring):
    odd = False
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            odd = not odd
    return odd


def slow_mask(ring, width, height):
    out = {(r, c) for r in range(height) for c in range(width) if ring and inside(c + 0.5, r + 0.5, ring)}
    if not out and ring:
        c, r = (int(sum(p[k] for p in ring) / len(ring) // 1) for k in (0, 1))
        if 0 <= c < width and 0 <= r < height:
            out = {(r, c)}
    return out


def test_masks(spark):
    rng = random.Random(8)
    shapes = [([(rng.uniform(-5, 25), rng.uniform(-5, 20)) for _ in range(rng.randrange(3, 9))], rng.randrange(1, 20), rng.randrange(1, 16)) for _ in range(120)]
    shapes += [([(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)], 6, 6), ([(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)], 6, 6), ([(2.1, 2.1), (2.2, 2.1), (2.2, 2.3)], 6, 6), ([(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)], 6, 6), ([(3.5, 0.0)], 6, 6), ([], 6, 6)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ring], w, h) for i, (ring, w, h) in enumerate(shapes)], RING)
    got = {}
    for r in series.mask_pixels(series.mask_spans(df, ["key"]), ["key"]).collect():
        got.setdefault(r.key, set()).add((r.row, r.col))
    for i, shape in enumerate(shapes):
        assert got.get(i, set()) == slow_mask(*shape), (i, shape)


def test_ring_is_the_area_without_the_site(spark):
    square = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    df = spark.createDataFrame([(1, square(0.0, 5.0), square(2.0, 3.0)), (2, square(0.0, 5.0), square(2.4, 2.45))], "key long, aoi_ring array<struct<x: double, y: double>>, site_ring array<struct<x: double, y: double>>")
    plans = df.withColumn("grid", F.struct(F.lit(5).alias("width"), F.lit(5).alias("height")))
    n = {(r.key, r.region): r["count"] for r in series.region_masks(plans, ["key"]).groupBy("key", "region").count().collect()}
    assert n == {(1, "site"): 1, (1, "ring"): 24, (2, "site"): 1, (2, "ring"): 24}


def world(spark, kinds, pixels=None):
    """One target at 105 E 52 N; a scene of each kind (cloud cover, day, class of all pixels)."""
    targets = spark.createDataFrame([(1, 105.0, 52.0, 105.0, 52.0)], "key long, w double, s double, e double, n double")
    scenes = spark.createDataFrame([(i, 104.5, 51.5, 105.5, 52.5, day, cloud, 32648) for i, (cloud, day, _) in enumerate(kinds)], "scene_id long, w double, s double, e double, n double, acquired_at timestamp, cloud_cover double, epsg int")
    images = spark.createDataFrame([(i, b, f"{i}/{b}", 490_000.0, 5_770_000.0, 20_000.0, 1, 1, 0.0001, -0.1) for i in range(len(kinds)) for b in ("red", "nir", "scl")], "scene_id long, band string, image string, x0 double, y0 double, resolution double, width int, height int, scale double, offset double")
    rows = [(f"{i}/{b}", 0, 0, v) for i, (_, _, scl) in enumerate(kinds) for b, v in (("red", 2000.0), ("nir", 4000.0), ("scl", float(scl)))]
    return targets, scenes, images, spark.createDataFrame(pixels or rows, "image string, col long, row long, value double")


def test_the_first_usable_scene_is_taken(spark):
    day = lambda y, d: dt.datetime(y, 7, d, 4)
    kinds = [(5.0, day(2018, 3), 9), (6.0, day(2018, 2), 4), (1.0, day(2018, 1), 8), (3.0, day(2019, 3), 9), (90.0, day(2020, 3), 4), (None, day(2020, 4), 4), (2.0, dt.datetime(2021, 6, 30), 4)]
    targets, scenes, images, pixels = world(spark, kinds)
    got = {r.year: r for r in series.yearly_series(targets, scenes, images, pixels, F.lit(dt.datetime(2021, 7, 20)), pixel_m=300.0).collect()}
    assert {y: (r.status, r.reason, r.scene_id, r.partial) for y, r in got.items()} == {
        2017: ("none", "no scenes", None, False), 2018: ("ok", None, 1, False), 2019: ("none", "cloudy", None, False), 2020: ("none", "no scenes", None, False), 2021: ("none", "not yet", None, True),
    }
    assert (got[2018].ndvi, got[2018].ring_ndvi, got[2018].valid_pct, got[2018].clear_pct) == (0.5, 0.5, 100, 100)
    none = series.yearly_series(targets, scenes.where("false"), images, pixels, F.lit(dt.datetime(2018, 1, 1)))
    assert [(r.year, r.reason) for r in none.collect()] == [(2017, "no scenes")]


def test_later_candidates_are_read_only_where_earlier_ones_fail(spark, monkeypatch):
    asked = []
    read = series.read_band
    monkeypatch.setattr(series, "read_band", lambda plans, images, pixels, band, *a: asked.append((band, sorted(r.scene_id for r in plans.collect()))) or read(plans, images, pixels, band, *a))
    day = lambda d: dt.datetime(2018, 7, d)
    targets, scenes, images, pixels = world(spark, [(1.0, day(1), 9), (2.0, day(2), 4), (3.0, day(3), 4)])
    rows = series.yearly_series(targets, scenes, images, pixels, F.lit(dt.datetime(2018, 12, 1)), pixel_m=300.0).collect()
    assert {r.year: r.scene_id for r in rows} == {2017: None, 2018: 1}
    assert asked == [("scl", [0]), ("scl", [1]), ("red", [1]), ("nir", [1])]


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        ((0.8, 0.6), (0.2, 0.1, False), (-0.6, 0.5, [])), ((0.8, 0.6), (0.2, 0.1, True), (-0.6, None, ["during activity"])), (None, (0.2, 0.1, True), (None, None, ["before missing"])),
        ((None, None), (None, None, False), (None, None, ["before cloudy", "after cloudy"])), ((0.8, None), (0.2, 0.1, True), (-0.6, None, [])), ((0.8, 0.6), None, (None, None, ["after missing"])),
    ],
)
def test_comparisons(spark, before, after, want):
    one = lambda side, more="": spark.createDataFrame([(1, *side)] if side else [], f"k int, ndvi double, nbr double{more}")
    r = raster.combine_indices(one(before), one(after, ", during_activity boolean"), ["k"]).first()
    assert (r.dndvi, r.dnbr, r.reasons) == want and (r.severity is None) == (want[1] is None)


def test_candidates_without_a_mask_are_no_missing_ones(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "place string, scene_id long, rank int")
    stats = spark.createDataFrame([(2, 100, 0, 0, 0, 0, 100, True)], "scene_id long, total long, nodata long, cloud long, shadow long, snow long, clear long, usable boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "place string")
    got = {r.place: (r.scene_id, r.checked, r.reason) for r in raster.pick_scene(asked, ranked, stats, ["place"]).collect()}
    assert got == {"a": (2, 2, None), "b": (None, 1, "cloudy"), "c": (None, 0, "missing")}


def test_no_table_of_the_series_is_broadcast(spark, tmp_path, monkeypatch):
    """Files of masks and pixels are small, as their values repeat; the rows in them, broadcast by their files' size, don't fit the driver."""
    day = lambda d: dt.datetime(2018, 7, d, 4)
    for name, df in zip(("targets", "scenes", "images", "pixels"), world(spark, [(1.0, day(1), 9), (2.0, day(2), 4), (3.0, day(3), 4)])):
        df.write.parquet(f"{tmp_path}/{name}")
    plans, write = [], series.materialize
    monkeypatch.setattr(series, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, tag))
    out = series.yearly_series(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("targets", "scenes", "images", "pixels")], F.lit(dt.datetime(2018, 12, 1)), 2018, pixel_m=300.0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [line for plan in plans for line in plan.splitlines() if "Broadcast" in line]
    r = out.first()
    assert (r.status, r.scene_id, r.clear_pct, r.ndvi, r.valid_pct, r.ring_ndvi, r.ring_valid_pct) == ("ok", 1, 100, 0.5, 100, 0.5, 100)

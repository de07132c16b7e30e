"""Work that must not grow with repeated places, seen by the rows that the heavy steps are given."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from emberlens.operators import context, geometry, incidents as I, protected, raster, series, spatial


def _watched(monkeypatch, module, name):
    """Counts of the tables that each call of a step is given."""
    seen, step = [], getattr(module, name)

    def watch(*args, **kwargs):
        seen.append(tuple(x.count() for x in args[:2]))
        return step(*args, **kwargs)

    monkeypatch.setattr(module, name, watch)
    return seen


def _crowd(spark):
    """90 points at two spots, and 60 roads along two lines."""
    points = spark.range(90).select("id", (F.lit(52.0) + (F.col("id") % 2) * 0.3).alias("lat"), F.lit(100.0).alias("lon"))
    k = F.col("id")
    roads = spark.range(60).select((k + 7).alias("ord"), F.concat(F.lit("r"), k).alias("name"), (F.lit(52.01) + (k % 2) * 0.3).alias("lat1"), F.lit(99.9).alias("lon1"), (F.lit(52.01) + (k % 2) * 0.3).alias("lat2"), F.lit(100.1).alias("lon2"))
    return points, roads


def test_segments_are_asked_by_spot(spark, monkeypatch):
    points, roads = _crowd(spark)
    seen = _watched(monkeypatch, spatial, "points_in_boxes")
    got = {r.id: r for r in spatial.nearest_segment(points, roads, 15.0, ["name"]).collect()}
    assert seen == [(2, 2)]
    assert len(got) == 90 and all(r.name == f"r{i % 2}" for i, r in got.items())
    assert all(1.1 < r.km < 1.12 for r in got.values())


def test_places_are_asked_by_spot(spark, monkeypatch):
    points, roads = _crowd(spark)
    places = roads.select(F.col("ord").alias("id"), "ord", "name", F.col("lat1").alias("lat"), F.lit(100.0).alias("lon"))
    seen = _watched(monkeypatch, spatial, "near_pairs")
    got = {r.id: r for r in spatial.nearest_point(points, places, 15.0, ["name"]).collect()}
    assert seen == [(2, 2)]
    assert len(got) == 90 and all(r.name == f"r{i % 2}" for i, r in got.items())


def test_context_is_found_by_spot(spark, monkeypatch):
    points, roads = _crowd(spark)
    incidents = points.withColumn("lat", F.when(F.col("id") >= 80, F.lit(None)).otherwise(F.col("lat") + F.col("id") * 1e-6))
    kinds = roads.withColumns({"paved": F.col("ord") % 3 == 0, "track": F.lit(False)})
    places = roads.select(F.col("ord").alias("id"), "ord", "name", F.col("lat1").alias("lat"), F.lit(100.0).alias("lon"))
    seen = _watched(monkeypatch, spatial, "nearest_segment")
    got = {r.id: r for r in context.incident_context(incidents, kinds, places, F.lit(None).cast("string"), F.lit("2024-01-01")).collect()}
    assert {n for n, _ in seen} == {2}
    assert len(got) == 90 and all((r.road and r.road.name) == (f"r{i % 2}" if i < 80 else None) for i, r in got.items())
    assert got[0].paved_road.name == "r2" and got[0].track is None and got[1].settlement.name == "r1" and got[85].settlement is None


# ---- static sources
def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sightings(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, 60 + rng.random() * 0.02, 100 + rng.random() * 0.04, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 14))) for i in range(400)]
    spark.createDataFrame(rows, "id long, lat double, lon double, acquired_at timestamp").write.parquet(f"{tmp_path}/points")
    return rows, spark.read.parquet(f"{tmp_path}/points")


def test_days_near_copies_cells_not_points(spark, tmp_path):
    rows, points = _sightings(spark, tmp_path)
    cells = spark.createDataFrame(I.heat_cells(points).collect())
    got = I.days_near(points, cells)
    assert not [line for line in _plan(got).splitlines() if "Generate" in line and "id#" in line]
    want, around = {}, cells.collect()
    for i, lat, lon, _ in rows:
        days = set()
        for c in around:
            a = math.sin(math.radians(c.lat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(c.lat)) * math.sin(math.radians(c.lon - lon) / 2) ** 2
            if 2 * 6371.0088 * math.asin(math.sqrt(a)) <= I.STATIC_RADIUS_KM:
                days |= set(c.days)
        if days:
            want[i] = sorted(days)
    assert {r.id: r.days for r in got.collect()} == want and len({len(v) for v in want.values()}) > 3


def test_observations_are_not_broadcast(spark, tmp_path):
    _, points = _sightings(spark, tmp_path)
    as_of = F.lit(dt.datetime(2024, 1, 14, 12))
    static = I.static_points(points, points, as_of)
    box = "bbox_min_lng double, bbox_min_lat double, bbox_max_lng double, bbox_max_lat double, center_lat double"
    state = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 14), 399, 99.0, 59.0, 101.0, 61.0, 60.0)], f"incident_id long, first_seen timestamp, last_seen timestamp, max_hotspot_id long, {box}")
    for df in (static, *I.split_static(points, static), I.static_places(points, as_of), I.cluster(points), I.relabelled(state, points, points, as_of)):
        assert not [line for line in _plan(df).splitlines() if "BroadcastHashJoin [id#" in line or "BroadcastHashJoin [row#" in line]


# ---- the yearly series
SCENE = "scene_id long, w double, s double, e double, n double, acquired_at timestamp, cloud_cover double, epsg int"


def _scenes(spark):
    """400 scenes of two summers, of two boxes, each listed twice."""
    rows = [(i, 104.0 + i % 2 * 0.3, 52.0, 104.6 + i % 2 * 0.3, 52.5, dt.datetime(2022 + i % 3 % 2, 7, 1 + i % 20), float(i * 37 % 90), 32648) for i in range(400)]
    return spark.createDataFrame(rows * 2, SCENE)


def test_scenes_of_one_box_are_cut_before_they_meet_targets(spark):
    targets = spark.createDataFrame([(k, 104.02 + k * 0.2, 52.1, 104.1 + k * 0.2, 52.2) for k in range(3)], "key long, w double, s double, e double, n double")
    areas, as_of = series.areas_of(targets, ["key"]), F.lit(dt.datetime(2023, 12, 1))
    every = series.find_scenes(areas, _scenes(spark), as_of, 2022)
    first = series.find_scenes(areas, _scenes(spark), as_of, 2022, most=raster.CANDIDATES)
    ranked = lambda found: sorted((r.key, r.year, r.rank, r.scene_id) for r in raster.candidates(found, ["key", "year"]).collect())
    assert ranked(first) == ranked(every) and len(ranked(first)) == 3 * 2 * raster.CANDIDATES
    assert first.count() == 5 * 2 * raster.CANDIDATES < every.count()  # the second and third target meet both boxes


def test_targets_with_one_box_are_worked_out_once(spark, monkeypatch):
    box = (104.02, 52.1, 104.1, 52.2)
    targets = spark.createDataFrame([(k, *box) for k in range(30)] + [(30, 104.3, 52.1, 104.4, 52.2), (31, None, 52.1, 104.1, 52.2)], "key long, w double, s double, e double, n double")
    images = spark.createDataFrame([], "scene_id long, band string, image string, x0 double, y0 double, resolution double, width int, height int, scale double, offset double")
    seen = _watched(monkeypatch, series, "find_scenes")
    out = series.yearly_series(targets, _scenes(spark), images, spark.createDataFrame([], "image string, col long, row long, value double"), F.lit(dt.datetime(2023, 12, 1)), 2022, 1000.0)
    got = {(r.key, r.year): (r.status, r.reason) for r in out.collect()}
    assert [n for n, _ in seen] == [3]
    assert len(got) == 64 and {got[k, y] for k in range(31) for y in (2022, 2023)} == {("none", "cloudy")} and got[31, 2022] == ("none", "no scenes")


def test_grids_are_worked_out_once_for_all_scenes(spark, monkeypatch):
    targets = spark.createDataFrame([(k, 104.02 + k * 0.3, 52.1, 104.1 + k * 0.3, 52.2) for k in range(2)], "key long, w double, s double, e double, n double")
    images = spark.createDataFrame([], "scene_id long, band string, image string, x0 double, y0 double, resolution double, width int, height int, scale double, offset double")
    seen, plan = [], series.plan_grids
    monkeypatch.setattr(series, "plan_grids", lambda areas, *a: seen.append(areas.count()) or plan(areas, *a))
    out = series.yearly_series(targets, _scenes(spark), images, spark.createDataFrame([], "image string, col long, row long, value double"), F.lit(dt.datetime(2023, 12, 1)), 2022, 1000.0)
    assert seen == [2]  # of two summers with six candidates each
    assert {(r.status, r.reason) for r in out.collect()} == {("none", "cloudy")}


def test_mask_rows_are_dealt_out_before_they_become_pixels(spark):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    shapes = spark.range(40).select(F.col("id").alias("key"), F.array(corner(0.0, 0.0), corner(50.0, 0.0), corner(50.0, 50.0), corner(0.0, 50.0)).alias("ring"), F.lit(50).alias("width"), F.lit(50).alias("height"))
    pixels = series.mask_pixels(series.mask_spans(shapes, ["key"]), ["key"])
    by_task = [r["count"] for r in pixels.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(by_task) == 40 * 50 * 50 and max(by_task) < 40 * 50 * 50 / 2


# ---- protected areas
def test_features_are_found_in_small_steps(spark):
    line = lambda *points: [{"lat": y, "lon": x} for x, y in points]
    way = lambda *points, role="outer": {"type": "way", "role": role, "geometry": line(*points)}
    rows = [(i, {"name": "Park"}, [way((100.0, 60.0), (100.2, 60.0), (100.2, 60.1)), way((100.2, 60.1), (100.0, 60.1), (100.0, 60.0)), way((100.05, 60.02), (100.1, 60.02), (100.1, 60.05), (100.05, 60.02), role="inner")]) for i in range(3)]
    relations = spark.createDataFrame(rows, protected.MEMBERS)
    rings, _ = protected.shapes(relations)
    assert sorted((r.id, r.polygon, r.ring, len(r.points)) for r in rings.collect()) == [(i, 0, k, (5, 4)[k]) for i in range(3) for k in (0, 1)]
    ways = spark.createDataFrame([(1, 0, "outer", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])], "relation long, ord int, role string, points array<struct<lon: double, lat: double>>")
    assert "FlatMapGroupsInPandas" not in _plan(geometry.assemble_rings(ways))  # a call of Python for each relation
    land = spark.createDataFrame([("R", 0, [[[(90.0, 50.0), (110.0, 50.0), (110.0, 70.0), (90.0, 70.0), (90.0, 50.0)]]])], "region string, ord int, polygons array<array<array<struct<lon: double, lat: double>>>>")
    out, _, bad = protected.features(relations, spatial.edges_of(land))
    assert _plan(out).count("Sort [") < 10 and len(out.collect()) == 3 and bad.count() == 0

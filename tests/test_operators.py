"""Operators against brute force, and their state over runs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlens.functions import numeric as N
from emberlens.operators import feed, geometry, incidents as I, raster, regional as R, spatial, status
from emberlens.operators.components import connected_components

T0 = dt.datetime(2026, 9, 24, 5)
POINTS = "id long, lat double, lon double, acquired_at timestamp, satellite string, confidence string, frp double, region_iso string, region string"
RINGS = "region string, ord int, polygons array<array<array<struct<lon: double, lat: double>>>>"


def km(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * N.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))


def points_of(spark, spots, **fixed):
    rows = [(i, *s, fixed.get("at", T0), "N", fixed.get("confidence", "nominal"), 10.0, "RU-IRK", "Irkutsk") for i, s in enumerate(spots)]
    return spark.createDataFrame(rows, POINTS)


def ring(*corners):
    return [{"lon": float(x), "lat": float(y)} for x, y in (*corners, corners[0])]


def square(x, y, size):
    return ring((x, y), (x + size, y), (x + size, y + size), (x, y + size))


# ---- spatial
def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, None)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_components_of_a_shuffled_chain(spark):
    ids = [int(i) for i in np.random.default_rng(6).permutation(3000)]
    edges = list(zip(ids, ids[1:])) + [(5001, 5000)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == dict.fromkeys(ids, 0) | {5000: 5000, 5001: 5000}


def test_distance_pairs(spark):
    rng = np.random.default_rng(1)
    spots = [(float(rng.choice([0, 52, 85, -89.9])) + float(rng.normal(0, 0.02)), float(rng.choice([0, 104, 179.999, -179.999])) + float(rng.normal(0, 0.03))) for _ in range(150)]
    spots = [(max(-90.0, min(90.0, a)), ((b + 180) % 360) - 180) for a, b in spots] + [spots[0]]
    want = {(i, j) for i in range(len(spots)) for j in range(i + 1, len(spots)) if km(spots[i], spots[j]) <= 2}
    assert {(r.a, r.b) for r in spatial.distance_pairs(points_of(spark, spots), 2.0).collect()} == want


def test_single_linkage(spark):
    rng = np.random.default_rng(2)
    spots = [(52 + float(rng.normal(0, 0.06)), 104 + float(rng.normal(0, 0.1))) for _ in range(120)] + [(60.0 + 0.0001 * (i % 7), 100.0) for i in range(60)]
    label = list(range(len(spots)))
    for i in range(len(spots)):
        for j in range(i):
            if km(spots[i], spots[j]) <= 2 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r.id: r.cluster for r in spatial.single_linkage(points_of(spark, spots), 2.0).collect()}
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("gap, clusters", [(0.0179, 1), (0.0181, 2)])
def test_linkage_threshold(spark, gap, clusters):
    assert spatial.single_linkage(points_of(spark, [(52.0, 104.0), (52.0 + gap, 104.0)]), 2.0).select("cluster").distinct().count() == clusters


def test_linkage_chain(spark):
    assert spatial.single_linkage(points_of(spark, [(52.0 + 0.015 * i, 104.0) for i in range(9)]), 2.0).select("cluster").distinct().count() == 1
    assert spatial.single_linkage(points_of(spark, []), 2.0).count() == 0


def test_regions(spark):
    shapes = [("a", 0, [[square(0, 0, 10), square(4, 4, 2)]]), ("b", 1, [[square(5, 5, 10)], [square(30, 0, 1)]])]
    edges = spatial.edges_of(spark.createDataFrame(shapes, RINGS))
    spots = [(1.0, 1.0), (5.0, 5.5), (5.5, 5.5), (7.0, 7.0), (12.0, 12.0), (0.5, 30.5), (40.0, 40.0), (4.5, 4.5)]
    p = points_of(spark, spots)
    assert {r.id: r.region for r in spatial.first_region(p, edges).collect()} == {0: "a", 1: "b", 2: "b", 3: "a", 4: "b", 5: "b"}  # 1 and 2 are in a's hole, 7 in nothing
    areas = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "region string, area double")
    got = {r.id: (r.relation, r.region) for r in spatial.area_relation(p, edges, areas, 100.0).collect()}
    assert got[3] == ("inside", "b") and got[6] == ("none", None) and got[7] == ("near", "a")


def test_regions_by_cells(spark):
    """Star-shaped polygons with holes over many cells, against a plain ray cast."""
    rng = np.random.default_rng(8)
    shapes, rings = [], {}
    for k in range(4):
        x, y = float(rng.uniform(0, 3)), float(rng.uniform(0, 3))
        angle = np.sort(rng.uniform(0, 2 * math.pi, 40))
        own = []
        for scale in (1.0, 0.3):
            r = scale * rng.uniform(0.7, 1.6, 40)
            ring = [(x + float(a * math.cos(t)), y + float(a * math.sin(t))) for a, t in zip(r, angle)]
            own.append([{"lon": a, "lat": b} for a, b in [*ring, ring[0]]])
        shapes.append((f"r{k}", k, [own]))
        rings[f"r{k}"] = own
    spots = [(float(a), float(b)) for a, b in rng.uniform(-2, 5, (1500, 2))]

    def odd(ring, lat, lon):
        hit = 0
        for a, b in zip(ring, ring[1:]):
            hit += (a["lat"] > lat) != (b["lat"] > lat) and lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return hit % 2 == 1

    want = {(i, r) for i, (lat, lon) in enumerate(spots) for r, (outer, hole) in rings.items() if odd(outer, lat, lon) and not odd(hole, lat, lon)}
    edges = spatial.edges_of(spark.createDataFrame(shapes, RINGS))
    assert {(r.id, r.region) for r in spatial.regions_containing(points_of(spark, spots), edges).collect()} == want and len(want) > 100
    assert spatial.polygon_cells(edges).where("whole").count() > 20


@pytest.mark.parametrize("gap, clusters", [(0.01785, 1), (0.0181, 2)])
def test_linkage_of_dense_places(spark, gap, clusters):
    """Two dense places whose nearest points, and no others, are about 2 km apart."""
    rng = np.random.default_rng(9)
    west = [(52.0 - float(a), 104.0 + float(b)) for a, b in rng.uniform(0, 0.004, (150, 2))] + [(52.0, 104.002)]
    east = [(52.0 + gap + float(a), 104.0 + float(b)) for a, b in rng.uniform(0.0005, 0.004, (150, 2))] + [(52.0 + gap, 104.002)]
    assert spatial.single_linkage(points_of(spark, west + east), 2.0).select("cluster").distinct().count() == clusters


def test_intervals_and_area(spark):
    rows = spark.createDataFrame([(1, 5.0, 7.0), (1, 0.0, 2.0), (1, 1.0, 3.0), (1, 7.0, 8.0)], "k int, low double, high double")
    assert sorted((r.low, r.high) for r in spatial.merge_intervals(rows, ["k"]).collect()) == [(0.0, 3.0), (5.0, 8.0)]
    regions = spatial.edges_of(spark.createDataFrame([("r", 0, [[square(0, 0, 2)]])], RINGS))
    overlap = [("x", 0, [[square(0, 0, 1)]]), ("y", 1, [[square(0, 0, 1)]]), ("z", 2, [[square(1, 1, 1), square(1.25, 1.25, 0.5)]])]
    got = spatial.covered_area_km2(spatial.edges_of(spark.createDataFrame(overlap, RINGS)), regions).first().km2
    cell = (math.pi / 180 * N.AREA_RADIUS_KM) ** 2
    assert got == pytest.approx(cell * 1.75, rel=2e-2)
    assert geometry.area_km2(regions).first().km2 == pytest.approx(4 * cell, rel=1e-3)


def test_rings(spark):
    def line(*corners):
        return [{"lon": float(x), "lat": float(y)} for x, y in corners]

    ways = [(1, 0, "outer", line((0, 0), (4, 0), (4, 4))), (1, 1, "outer", line((0, 0), (0, 4), (4, 4))), (1, 2, "inner", square(1, 1, 1)), (1, 3, "inner", square(9, 9, 1)), (1, 4, "outer", line((7, 7), (8, 8)))]
    got = geometry.assemble_rings(spark.createDataFrame(ways, "relation long, ord int, role string, points array<struct<lon: double, lat: double>>")).collect()
    assert sorted((r.polygon, r.ring, len(r.points)) for r in got) == [(0, 0, 5), (0, 1, 5)]
    circle = [{"lon": math.cos(i * math.pi / 1000) * 9, "lat": math.sin(i * math.pi / 1000) * 9} for i in range(2000)]
    thin = geometry.simplify_rings(spark.createDataFrame([(circle + circle[:1],), (square(0, 0, 1),)], "points array<struct<lon: double, lat: double>>")).collect()
    assert len(thin[0].points) <= 300 and thin[0].points[0] == thin[0].points[-1] and len(thin[1].points) == 5


# ---- incidents
def test_build(spark):
    rows = [(3, 52.0, 104.0, T0, "N20", "high", 10.0), (5, 52.001, 104.0, T0 + dt.timedelta(hours=1), "N", "nominal", 15.5), (12, 52.02, 104.01, T0 + dt.timedelta(hours=1), "N", None, None), (20, 40.0, 100.0, T0, "N", "nominal", 1.0), (21, 30.0, 100.0, T0, "N", "high", 1.0)]
    p = spark.createDataFrame([(*r, "RU-IRK", "Irkutsk") for r in rows], POINTS)
    got = {r.cluster: r for r in I.build_incidents(I.cluster(p, 3.0), F.lit(T0 + dt.timedelta(hours=30))).collect()}
    assert set(got) == {3, 21}
    r = got[3]
    assert (r.hotspot_count, r.high_count, r.frp_sum, r.frp_max, r.satellite, r.max_hotspot_id, r.cluster_key, r.confidence, r.status) == (3, 1, 25.5, 15.5, "N,N20", 12, "3", 0.33, "active")
    assert r.area_ha == round(r.pixel_count * 14.06, 2)


def test_runs_are_idempotent(spark):
    def p(rows):
        return spark.createDataFrame([(i, lat, 104.0, T0 + dt.timedelta(hours=h), "N", "nominal", 1.0, "RU-IRK", "Irkutsk") for i, lat, h in rows], POINTS)

    from emberlens.streaming.ingest import incident_schema

    def run(state, rows, hours):
        points, as_of = p(rows), F.lit(T0 + dt.timedelta(hours=hours))
        out = I.next_state(state, *I.plan(I.cluster(I.in_window(points, as_of)), state, as_of))
        return spark.createDataFrame(out.orderBy("incident_id").collect(), out.schema)

    rows = [(1, 52.0, 0), (2, 52.001, 0), (3, 55.0, 0), (4, 55.001, 0), (5, 57.0, 0)]
    one = run(spark.createDataFrame([], incident_schema(p(rows))), rows, 1)
    assert [(r.incident_id, r.hotspot_count, r.status) for r in one.collect()] == [(1, 2, "active"), (2, 2, "active")]
    assert run(one, rows, 1).collect() == one.collect()
    grown = rows + [(9, 52.002, 20), (10, 52.03, 20), (11, 52.031, 20)]
    two = run(one, grown, 49)
    assert [(r.incident_id, r.hotspot_count, r.max_hotspot_id, r.status) for r in two.collect()] == [(1, 3, 9, "active"), (2, 2, 4, "inactive"), (3, 2, 11, "active")]
    assert run(two, grown, 49).collect() == two.collect()
    three = run(two, grown + [(15, 55.0, 60)], 61)
    assert [(r.hotspot_count, r.status) for r in three.collect()] == [(3, "active"), (3, "active"), (2, "active")]


def test_static_sources(spark):
    flare = [(i, 60.7201 + 0.0003 * (i % 2), 108.0503, T0 + dt.timedelta(days=i // 2)) for i in range(16)]
    moving = [(100 + i, 58.3 + 0.008 * (i // 3), 107.2 + 0.012 * (i // 3), T0 + dt.timedelta(days=i // 3)) for i in range(24)]
    p = spark.createDataFrame([(*r, "N", "nominal", 1.0, "RU-IRK", "Irkutsk") for r in flare + moving], POINTS)
    as_of = F.lit(T0 + dt.timedelta(days=7))
    assert {r.id for r in I.static_points(p, p, as_of).collect()} == set(range(16))
    week = p.where(F.col("acquired_at") < F.lit(T0 + dt.timedelta(days=6)))
    assert I.static_points(week, week, as_of).count() == 0
    listed = spark.createDataFrame([(58.3, 107.2)], "lat double, lon double").select(N.heat_row("lat").alias("row"), N.heat_col(N.heat_row("lat"), "lon").alias("col"))
    assert {r.id for r in I.static_points(week, week, as_of, listed).collect()} == {100, 101, 102}
    members = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 100)], "incident_id long, id long")
    assert [r[0] for r in I.static_incidents(members, I.static_points(p, p, as_of)).collect()] == [1]


# ---- feed
def test_requests():
    r = feed.parse_request({"sort": "x", "limit": "9999", "offset": "-1", "id": "0", "source": "a;b", "status": "gone", "region": " R ", "start_date": "2024-13-01", "static_sources": "only"})
    assert r == {"sort": "date_desc", "limit": 100, "offset": 0, "filters": {"static_sources": "only", "region": "R"}}
    assert feed.parse_request({"id": "42", "source": "firms"})["filters"] == {"static_sources": "exclude", "id": 42, "source": "firms"}
    assert feed.cache_key({"limit": "3"}) == "incidents:sort=date_desc&limit=3&offset=0&static_sources=exclude"


# ---- regional
def test_deviation(spark):
    series = [("a", y, v) for y, v in zip(range(2019, 2025), (1000, 2000, 3000, 4000, 5000, 1500))] + [("b", y, 0) for y in range(2019, 2025)] + [("c", y, 5) for y in range(2020, 2025)]
    got = {r.region: r for r in R.deviation(spark.createDataFrame(series, "region string, year int, value long")).where("year = 2024").collect()}
    assert (got["a"].deviation_pct, got["a"].baseline) == (-50.0, 3000.0)
    assert (got["b"].deviation_pct, got["b"].reason) == (None, "mean is zero") and (got["c"].deviation_pct, got["c"].reason) == (None, "years missing")


def test_names(spark):
    rows = spark.createDataFrame([("г. Город",), ("Край (старый)",), ("Всего по стране",), ("Неизвестно",), ("",), (None,), ("Крым",)], "name string")
    aliases = spark.createDataFrame([("город", "RU-A"), ("край", "RU-B"), ("крым", "RU-C")], "alias string, iso string")
    excluded = spark.createDataFrame([("крым", "not covered")], "alias string, reason string")
    got = {r.name: (r.kind, r.iso, r.reason) for r in R.classify_names(rows, aliases, excluded, [("^(всего|итого)( |$)", "total")]).collect()}
    assert got["г. Город"] == ("region", "RU-A", None) and got["Край (старый)"] == ("region", "RU-B", None) and got["Крым"] == ("excluded", None, "not covered")
    assert got["Всего по стране"] == ("excluded", None, "total") and got["Неизвестно"] == ("unmapped", None, None) and got[""] == ("excluded", None, "empty name")


def test_newest_value(spark):
    rows = [("a", 1.0, 2020, 0), ("a", None, 2023, 1), ("a", 3.0, 2022, 2), ("b", None, None, 0), ("c", 7.0, None, 0), ("c", 8.0, None, 1)]
    got = {r.iso: (r.value, r.year) for r in R.newest_values(spark.createDataFrame(rows, "iso string, value double, year int, ord int")).collect()}
    assert got == {"a": (3.0, 2022), "b": (None, None), "c": (7.0, None)}


def test_indicators(spark):
    regions = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "region string, name string")
    values = spark.createDataFrame([("a", 0.0, "2024"), ("b", None, "2024")], "region string, value double, period string")
    got = {r.region: (r.value, r.reason) for r in R.indicators(regions, {"x": (values, "ha", "official")}).collect()}
    assert got == {"a": (0.0, None), "b": (None, "no value in source"), "c": (None, "region not in source")}


# ---- rasters
def test_rasters(spark):
    pixels = spark.createDataFrame([(1, 4)] * 16 + [(1, 8)] * 4 + [(2, 11)] * 6 + [(2, 4)] * 4 + [(3, 0)] * 2 + [(3, 4)] * 18, "scene int, scl int")
    got = {r.scene: (r.clear, r.total, r.usable) for r in raster.scl_stats(pixels, ["scene"]).collect()}
    assert got == {1: (16, 20, True), 2: (4, 10, False), 3: (18, 20, False)}
    refl = spark.createDataFrame([(1, 0.1, 0.5, 0.4), (1, 0.1, 0.5, 0.4), (2, None, 0.5, 0.4), (2, 0.1, 0.5, 0.4), (3, None, 0.5, 0.4)], "k int, red double, nir double, swir2 double")
    stats = {r.k: (r.total, r.valid, r.valid_pct, r.ndvi, r.nbr) for r in raster.index_stats(refl, ["k"]).collect()}
    assert stats == {1: (2, 2, 100, 0.667, 0.111), 2: (2, 1, 50, 0.667, 0.111), 3: (1, 0, 0, None, None)}


def test_pick_scene(spark):
    """Snow must spoil most of the covered scenes that were looked at; a scene of one acquisition is taken by its clouds; ids come once."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    scenes = [("a", "x", 50.0, at(0)), ("a", "y", 10.0, at(50)), ("a", "z", None, at(100)), ("a", "late", 1.0, at(300)), ("a", "x", 50.0, at(0)), ("b", "s1", 1.0, at(0)), ("b", "s2", 2.0, at(999)), ("b", "dark", 3.0, at(1999)), ("c", "s1", 1.0, at(0)), ("c", "cl", 2.0, at(999))]
    df = spark.createDataFrame(scenes, "place string, scene_id string, cloud_cover double, acquired_at timestamp")
    order = lambda newest: [r.scene_id for r in raster.ordered_candidates(df.where("place = 'a'"), ["place"], newest, most=4).orderBy("rank").collect()]
    assert order(False) == ["y", "x", "z", "late"] and order(True) == ["late", "y", "x", "z"]
    stats = [("x", 10, 9, 0, 1, 0, 0, True), ("y", 10, 2, 0, 8, 0, 0, False), ("z", 10, 9, 0, 1, 0, 0, True), ("late", 10, 2, 0, 8, 0, 0, False), ("s1", 10, 5, 0, 1, 1, 3, False), ("s2", 10, 5, 0, 2, 0, 3, False), ("dark", 10, 5, 5, 0, 0, 0, False), ("cl", 10, 5, 0, 5, 0, 0, False)]
    stats = spark.createDataFrame(stats, "scene_id string, total long, clear long, nodata long, cloud long, shadow long, snow long, usable boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "place string")
    got = {r.place: (r.scene_id, r.checked, r.reason) for r in raster.pick_scene(asked, raster.ordered_candidates(df, ["place"]), stats, ["place"]).collect()}
    assert got == {"a": ("x", 2, None), "b": (None, 3, "snow"), "c": (None, 2, "cloudy"), "d": (None, 0, "missing")}
    box = spark.createDataFrame([("p", None, 0.0), ("q", 70.0, 0.0), ("r", 20.0, 0.0), ("far", 1.0, 50.0)], "scene_id string, cloud_cover double, w double").selectExpr("*", "w + 1 AS e", "0D AS s", "1D AS n", "timestamp'2024-05-01' AS acquired_at")
    found = raster.search_scenes(box, {"w": 0.5, "s": 0.5, "e": 2, "n": 2}, F.lit("2024-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp"), by_cloud=True)
    assert [r.scene_id for r in found.collect()] == ["r", "q"]


def test_regions_in_russian_order(spark):
    rows = spark.createDataFrame([("RU-Z", "Якутия"), ("RU-E", "Ёлкино"), ("RU-D", "Елань"), ("RU-ZH", "Жиздра"), ("RU-IRK", "Иркутск")], "region string, name string")
    assert [r.name for r in R.sort_regions(rows).collect()] == ["Иркутск", "Елань", "Ёлкино", "Жиздра", "Якутия"]


def test_relabels_and_counters(spark):
    p = points_of(spark, [(52.0, 104.0), (52.001, 104.0), (60.0, 100.0), (60.001, 100.0)])
    state = I.build_incidents(I.cluster(p), F.lit(T0)).withColumn("incident_id", F.col("cluster")).select(*I.STATE)
    days = [points_of(spark, [(52.0, 104.0), (52.001, 104.0)], at=T0 - dt.timedelta(days=k)) for k in (8, 5, 3, 0)]
    history = days[0].union(days[1]).union(days[2]).union(days[3])
    relabels = I.static_relabels(state, p, history, F.lit(T0))
    assert [r.incident_id for r in relabels.collect()] == [0]
    none = state.limit(0)
    creates = I.build_incidents(I.cluster(p.limit(0)), F.lit(T0))
    after = I.next_state(state, creates, none, none.select("incident_id", "status"), relabels)
    assert {r.incident_id: r.status for r in after.collect()} == {0: "static_source", 2: "active"}
    assert I.static_relabels(after, p, history, F.lit(T0)).count() == 0
    counted = I.run_counters(creates, none, none.select("incident_id", "status"), relabels, p.where("id < 2")).first()
    assert (counted.created, counted.updated, counted.deactivated, counted.relabelled, counted.masked) == (0, 0, 0, 1, 2)


# ---- status
def test_journal(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    runs = spark.createDataFrame([(1, "a", at(0), True), (2, "a", at(1), False), (3, "a", at(2), False), (4, "b", at(0), False), (5, "b", at(1), True)], "run_id int, source string, at timestamp, ok boolean")
    got = {r.source: r for r in status.run_summary(runs).collect()}
    assert got["a"].failing_since == at(1) and got["a"].last_success == at(0) and got["a"].last_ok is False and got["b"].failing_since is None
    registry = spark.createDataFrame([("a", 3600, 7200), ("b", 3600, 7200), ("c", 1, 2)], "source string, fresh_within long, stale_after long")
    newest = runs.groupBy("source").agg(F.max("at").alias("newest"))
    states = {r.source: (r.data_state, r.access_state, r.state) for r in status.source_status(registry, status.run_summary(runs), newest, F.lit(at(3))).collect()}
    assert states == {"a": ("fresh", "fresh", "fresh"), "b": ("delayed", "fresh", "delayed"), "c": ("unknown", "unknown", "unknown")}
    assert [r.run_id for r in status.throttled(runs, 7200).where("write").orderBy("run_id").collect()] == [1, 2, 4, 5]

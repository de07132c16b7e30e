"""Small parts that no registered query reaches, against values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlens.functions import numeric as N, periods, text as T
from emberlens.operators import context, geometry, official, raster, regional as R, status
from emberlens.operators.ranges import running_sums
from emberlens.sources import readers, sinks


def test_boxes_and_texts(spark):
    box = lambda w, s, e, n: dict(zip("wsen", map(F.lit, (w, s, e, n))))
    a, b, far = box(0.0, 0.0, 2.0, 2.0), box(1.0, 1.0, 3.0, 3.0), box(5.0, 5.0, 6.0, 6.0)
    row = spark.range(1).select(N.bboxes_meet(a, b).alias("x"), N.bboxes_meet(a, far).alias("y"), F.struct(*[v.alias(k) for k, v in N.clip_bbox(a, b).items()]).alias("z"), T.format_bbox(F.lit(1.0), F.lit(-2.5)).alias("t"), T.excerpt(F.lit("  a \n b  " + "c" * 300)).alias("u")).first()
    assert (row.x, row.y, tuple(row.z), row.t) == (True, False, (1.0, 1.0, 2.0, 2.0), "1.00000,-2.50000")
    assert row.u == ("a b " + "c" * 300)[:200]


def test_rings_that_are_none(spark):
    point = lambda x, y: {"lon": x, "lat": y}
    good = [point(0.0, 0.0), point(1.0, 0.0), point(1.0, 1.0), point(0.0, 0.0)]
    rows = [(0, good), (1, good[:3]), (2, good[:3] + [point(0.0, 1.0)]), (3, [*good[:2], point(0.0, 91.0), good[0]])]
    df = spark.createDataFrame(rows, "k int, points array<struct<lon: double, lat: double>>")
    got = {r.k: r.p for r in df.select("k", geometry.ring_problem(F.col("points")).alias("p")).collect()}
    assert got == {0: None, 1: "too few points", 2: "not closed", 3: "off the globe"}


def test_gates(spark):
    rows = spark.createDataFrame([(2020.0, 1.0, 1.0), (2000.0, 1.0, 1.0), (2020.5, 1.0, 1.0), (2020.0, -1.0, 1.0), (2020.0, 1.0, None)], "year double, area_ha double, emissions double")
    assert [r.p for r in rows.select(status.problems_of(status.loss_rules(2024)).alias("p")).collect()] == [None, "year", "year", "area", "emissions"]
    counts = spark.createDataFrame([(19, 0), (20, 41), (21, 42), (30, 40)], "n long, last long")
    assert [r.p for r in counts.select(status.count_problem(F.col("n"), F.col("last")).alias("p")).collect()] == ["too few", "fewer than half of the last", None, None]
    states = spark.createDataFrame([("stale", "delayed"), ("stale", "fresh"), ("fresh", "fresh"), ("unknown", "unknown")], "data string, access string")
    assert [r.w for r in states.select(status.why("data", "access").alias("w")).collect()] == ["access delayed", "data stale", None, "data unknown"]


def test_series_and_pixels(spark):
    counts = spark.createDataFrame([("a", 2022, 5), ("a", 2023, 6)], "region string, year int, vegetation long")
    assert [r.year for r in R.complete_years(counts, 2023).collect()] == [2022]
    loss = spark.createDataFrame([("a", 30, 2001, 1.0, 2.0), ("a", 30, 2001, 3.0, 4.0), ("a", 10, 2001, 9.0, 9.0), ("b", 30, 2001, 9.0, 9.0), ("a", 30, 2030, 9.0, 9.0)], "region string, threshold int, year int, area double, emissions double")
    assert [tuple(r) for r in R.loss_by_year(loss, "a", 2001, 2024).collect()] == [(2001, 4.0, 6.0)]
    before, after = (spark.createDataFrame([(1, ndvi, nbr)], "k int, ndvi double, nbr double") for ndvi, nbr in ((0.8, 0.6), (0.2, 0.1)))
    r = raster.combine_indices(before, after, ["k"]).first()
    assert (r.dndvi, r.dnbr, r.severity) == (-0.6, 0.5, "moderate_high")
    pixels, ids = spark.range(5), spark.createDataFrame([(1,), (2,), (9,)], "id long")
    assert sorted(r.id for r in raster.mask_pixels(pixels, ids).collect()) == [1, 2]
    assert [r.id for r in raster.mask_pixels(pixels, ids, ids.where("id = 1")).collect()] == [2]


def test_files(spark, tmp_path):
    listing = spark.createDataFrame([("a", "x/data-20240101.csv"), ("b", "see data-20250101.csv, data-20230101.csv"), ("c", None)], "property string, value string")
    assert readers.newest_path(listing).first().path == "data-20250101.csv"
    assert readers.newest_path(listing.where("property = 'c'")).first().path is None
    sinks.write_features(spark.createDataFrame([("{}",), ('{"a":1}',)], "feature string"), str(tmp_path / "f"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "f")).collect()) == ['{"a":1}', "{}"]


def test_official_numbers(spark):
    texts = ["12.5 thousand", " -3", ".5", "1e3x", "n/a", "", None, "12,5"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(official.number_or_zero(F.col("t")).alias("v")).collect()]
    assert got == [12.5, -3.0, 0.5, 1000.0, 0.0, 0.0, 0.0, 12.0]
    rows = spark.createDataFrame([(0, "a", "5"), (1, None, "6"), (2, "", "7")], "ord int, name string, number2023 string")
    assert [tuple(r) for r in official.typed(rows, "fires").collect()] == [(0, "a", 5.0), (1, "unknown", 6.0)]
    none = official.summary(*[official.typed(spark.createDataFrame([], "ord int, region string, subject string, year string, area string, volume string"), t) for t in ("wood_volume", "forestland", "reforestation", "fires_area")]).first()
    assert (none.wood_volume, none.forestland, none.reforested_year, none.fires_area) == (0.0, 0.0, None, 0.0)


def test_context_without_a_centre(spark):
    roads = spark.createDataFrame([(1, "road", False, False, 52.0, 104.0, 52.0, 104.1), (2, "trail", False, True, 52.05, 104.0, 52.05, 104.1)], "ord long, name string, paved boolean, track boolean, lat1 double, lon1 double, lat2 double, lon2 double")
    towns = spark.createDataFrame([(1, 1, "town", 52.02, 104.05)], "id long, ord long, name string, lat double, lon double")
    asked = spark.createDataFrame([(1, 52.01004, 104.05), (2, None, None)], "id long, lat double, lon double")
    got = {r.id: r for r in context.incident_context(asked, roads, towns, F.lit(None).cast("date"), F.lit(dt.date(2024, 1, 1))).collect()}
    r = got[1]
    assert (r.lat, r.road.name, r.paved_road, r.track.name, r.settlement.name, r.data_date) == (52.01, "road", None, "trail", "town", dt.date(2024, 1, 1)) and 1.0 < r.road.km < 1.2
    assert got[2].road is None and got[2].settlement is None


def test_running_sums(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 10 > 0, F.col("id") * 37 % 1000).alias("k"))
    rows = running_sums(df, [F.col("k").asc_nulls_last(), F.col("id")], {"n": F.lit(1), "total": F.col("v")}).collect()
    n = total = 0
    for r in sorted(rows, key=lambda r: (r.k is None, r.k or 0, r.id)):
        assert (r.n, r.total) == (n, total)
        n, total = n + 1, total + r.v
    assert running_sums(df.where("false"), [F.col("k")], {"n": F.lit(1)}).count() == 0


def test_checks_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"subject {i}",) for i in range(80)] + [(" Subject 1 ",), ("",)], "name string")
    assert status.subjects_problem(rows).count() == 0 and status.subjects_problem(rows.limit(10)).first().problem == "10 subjects"
    assert status.missing_groups(["region", "total"], [("subjects", "region"), ("woodiness",)]) == ["woodiness"]
    log = status.verdict_rows(spark.createDataFrame([(30, 4, False), (30, 0, True)], "total long, rejected long, passed boolean"), "firms", "rows", "too many bad rows").collect()
    assert [(r.source, r.check, r.ok, r.reason) for r in log] == [("firms", "rows", False, "too many bad rows"), ("firms", "rows", True, None)]
    (tmp_path / "a.csv").write_text("x" * 100)
    (tmp_path / "b.csv").write_text("x" * 10)
    assert [r.path.rsplit("/", 1)[1] for r in readers.oversized(spark, str(tmp_path), 50).collect()] == ["a.csv"]
    regions = spark.createDataFrame([("RU-A", 1), ("RU-B", 2), ("RU-C", 3)], "region string, ord int")
    assert sorted(r.region for r in readers.expected(regions, ["RU-A", "RU-C"]).collect()) == ["RU-A", "RU-C"]
    with pytest.raises(Exception, match="regions are missing"):
        readers.expected(regions, ["RU-A", "RU-X"]).collect()


def test_periods_and_days(spark):
    key = periods.series_key(tuple(map(F.lit, (1.0, 2.0, 3.0, 4.0))), tuple(map(F.lit, (1.5, 2.5, 2.0, 3.0))))
    days = F.array(*[F.lit(dt.date(2024, 1, d)) for d in (1, 3, 9)])
    row = spark.range(1).select(key.alias("k"), periods.day_span(days).alias("d"), periods.nrt_since(F.lit(dt.datetime(2024, 5, 6, 7)), F.lit("2024-05-01")).alias("s")).first()
    assert tuple(row) == ("1.00000,2.00000,3.00000,4.00000|1.50000,2.50000,2.00000,3.00000", 8, dt.date(2024, 5, 1))
    cells = R.nrt_cells(spark.createDataFrame([(52.0, 104.0, dt.datetime(2024, 5, 1)), (53.0, 104.0, dt.datetime(2024, 5, 3))], "lat double, lon double, acquired_at timestamp"))
    assert R.newest_day(cells).first().last_day == dt.date(2024, 5, 3)


def test_regions_export(spark):
    regions = spark.createDataFrame([("A", "a"), ("B", "b")], "region string, name string")
    values = spark.createDataFrame([("A", 1.5, "2024"), ("B", None, "2024")], "region string, value double, period string")
    table = R.indicators(regions, {"x": (values, "ha", "official"), "y": (values.where("region = 'A'"), "km", "estimate"), "z": (values, "m", "official")})
    registry = spark.createDataFrame([("x", 1, "X label", "src", None), ("y", 2, "Y label", "other", True)], "indicator string, place int, label string, source string, approximate boolean")
    rows = R.export_rows(table, registry, ("B",))
    got = {(r.region, r.indicator): (r.value, r.reason, r.pinned, r.approximate, r.label) for r in rows.collect()}
    assert tuple(rows.columns) == R.EXPORT_COLUMNS
    assert got == {("A", "x"): (1.5, None, False, False, "X label"), ("B", "x"): (None, "no value in source", True, False, "X label"), ("A", "y"): (1.5, None, False, True, "Y label"), ("B", "y"): (None, "region not in source", True, True, "Y label")}
    sources = spark.createDataFrame([("src", "open"), ("other", None)], "source string, license string")
    errors = spark.createDataFrame([("nrt: down",), ("gfw: 500",)], "error string")
    m = R.export_metadata(rows, sources, F.lit("2026-01-01"), {"boundaries": "b.geojson"}, errors).first()
    assert (m.dataset, m["count"], m.region_count, m.source_errors, m.files) == ("regions", 4, 2, ["gfw: 500", "nrt: down"], {"boundaries": "b.geojson"})
    assert [s.source for s in m.sources] == ["other", "src"] and m.methods.baseline_years == 5
    empty = R.export_metadata(rows.where("false"), sources.where("false"), F.lit(None).cast("string"), {}, errors.where("false")).first()
    assert (empty["count"], empty.sources, empty.source_errors, empty.files) == (0, [], [], {})


def test_scenes_by_id_and_platform(spark):
    s = spark.createDataFrame([("S2A_1", "sentinel-2b", 1), ("S2A_1", "sentinel-2c", 2), ("S2B_2", None, 1), ("L8", "landsat", 1), (None, "Sentinel-2A", 1)], "scene_id string, platform string, acquired_at int")
    assert sorted(r.p for r in s.select(T.platform_label("platform", "scene_id").alias("p")).collect()) == ["Sentinel-2", "Sentinel-2A", "Sentinel-2B", "Sentinel-2B", "Sentinel-2C"]
    assert [r.platform for r in raster.scene_by_id(s, "S2A_1").collect()] == ["sentinel-2c"] and raster.scene_by_id(s, "none").count() == 0

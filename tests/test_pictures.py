"""Projection, grids, resampling, time spans, colours and protected areas against values worked out by hand or by brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlens.functions import periods, projection as P, spectral as S, territory
from emberlens.operators import raster, status


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_utm(spark):
    zone = lambda lat, lon, code: P.utm(F.lit(lat), F.lit(lon), F.lit(code))
    middle, north, south, none = one(spark, zone(0.0, 105.0, 32648), zone(52.0, 104.0, 32648), zone(-52.0, 104.0, 32748), zone(1.0, 1.0, 4326))
    assert tuple(middle) == (500000.0, 0.0) and none is None
    # a meridian arc of 52 degrees on WGS84 is 5,763,343.55 m long (series of the published meridian distance)
    e2 = P.FLATTENING * (2 - P.FLATTENING)
    grid = np.linspace(0, np.radians(52), 200_001)
    speed = P.SEMI_AXIS_M * (1 - e2) / (1 - e2 * np.sin(grid) ** 2) ** 1.5
    arc = np.trapezoid(speed, grid)
    (on_axis,) = one(spark, zone(52.0, 105.0, 32648))
    assert on_axis.x == pytest.approx(500000) and on_axis.y == pytest.approx(arc * P.SCALE, abs=1e-3)
    assert north.x < 500000 and north.x == pytest.approx(south.x) and north.y == pytest.approx(10_000_000 - south.y)


def test_grids(spark):
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("wsen", (1000, 2000, 1205, 2100), strict=True)])
    grid = P.plan_grid(box)
    got, wide = one(spark, grid, P.plan_grid(F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("wsen", (0, 0, 10240, 10), strict=True)])))
    assert got.asDict() == {"w": 997.5, "s": 2000.0, "e": 1207.5, "n": 2100.0, "width": 21, "height": 10, "pixel": 10.0}
    assert (wide.width, wide.height, wide.pixel) == (512, 1, 20.0)
    levels = F.array(*[F.lit(x) for x in (10.0, 20.0, 40.0)])
    assert one(spark, *[P.pick_level(levels, F.lit(t)) for t in (5.0, 10.0, 39.9, 40.0, 400.0)]) == (0, 0, 1, 2, 2)
    window, none = one(spark, P.pixel_window(box, 990.0, 2110.0, 20.0, F.lit(100), F.lit(100)), P.pixel_window(box, 5000.0, 2110.0, 20.0, F.lit(100), F.lit(100)))
    assert tuple(window) == (0, 0, 11, 6) and none is None
    assert tuple(one(spark, P.grid_pixel(F.lit(1002.5), F.lit(2095.0), grid))[0]) == (0.5, 0.5)


def slow_resample(src, fx, fy, bilinear):
    h, w = src.shape
    nx, ny = int(np.floor(fx + 0.5)), int(np.floor(fy + 0.5))
    if not (0 <= nx < w and 0 <= ny < h):
        return 0.0
    x0, y0 = (max(0, min(m - 1, int(np.floor(f)))) for f, m in ((fx, w), (fy, h)))
    x1, y1 = min(w - 1, x0 + 1), min(h - 1, y0 + 1)
    four = np.array([[src[y0, x0], src[y0, x1]], [src[y1, x0], src[y1, x1]]], float)
    if not bilinear or src[ny, nx] == 0 or (four == 0).any():
        return float(src[ny, nx])
    tx, ty = min(1, max(0, fx - x0)), min(1, max(0, fy - y0))
    return float((four[0] @ [1 - tx, tx]) * (1 - ty) + (four[1] @ [1 - tx, tx]) * ty)


@pytest.mark.parametrize("bilinear", [False, True])
def test_resample(spark, bilinear):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 6, (9, 8))  # zeros are no data
    pixels = spark.createDataFrame([("a", c, r, float(image[r, c])) for r in range(9) for c in range(8) if image[r, c]], "image string, col long, row long, value double")
    plan = spark.createDataFrame([("a", (95.0, 20.0, 185.0, 104.0, 15, 14, 6.0), 100.0, 100.0, 10.0, (1, 0, 8, 7))], "image string, grid struct<w:double,s:double,e:double,n:double,width:int,height:int,pixel:double>, x0 double, y0 double, resolution double, window struct<x0:long,y0:long,x1:long,y1:long>")
    got = {(r.col, r.row): r.value for r in raster.resample(pixels, plan, bilinear).collect()}
    assert len(got) == 15 * 14
    part = image[0:7, 1:8]
    for (c, r), value in got.items():
        fx, fy = (95 + (c + 0.5) * 6 - 110) / 10 - 0.5, (100 - (104 - (r + 0.5) * 6)) / 10 - 0.5
        assert value == pytest.approx(slow_resample(part, fx, fy, bilinear)), (c, r)
    assert raster.resample(pixels, plan.where("false"), bilinear).count() == 0


def test_boxes_without_a_zone(spark):
    boxes = spark.createDataFrame([(1, 104.0, 52.0, 104.1, 52.1), (2, None, 52.0, 104.1, 52.1)], "id long, w double, s double, e double, n double")
    a, b = raster.project_boxes(boxes, ["id"], F.lit(32648)).orderBy("id").collect()
    assert 6000 < a.box.e - a.box.w < 7500 and a.box.n > a.box.s
    assert raster.project_boxes(boxes, ["id"], F.lit(1)).where("box IS NOT NULL").count() == 0


def test_periods(spark):
    t = lambda *x: F.lit(dt.datetime(*x))
    before, after, late = one(spark, periods.before_window(t(2024, 3, 1)), periods.after_window(t(2024, 3, 1), t(2024, 3, 2)), periods.after_window(t(2024, 3, 2), t(2024, 3, 2)))
    assert (before.start, before.end) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 29)) and after.start == dt.datetime(2024, 3, 1, 0, 0, 1) and late is None
    assert one(spark, periods.series_years(t(2019, 6, 30, 23)), periods.series_years(t(2019, 7, 1)), periods.series_years(t(2016, 1, 1))) == ([2017, 2018], [2017, 2018, 2019], [])
    assert one(spark, periods.is_partial(2024, t(2024, 8, 31)), periods.search_window(2024, t(2024, 7, 9))["end"]) == (True, dt.datetime(2024, 7, 9))
    now = dt.datetime(2024, 3, 10, 5)
    assert periods.period_range("7", None, None, now) == {"start_date": "2024-03-04"} and periods.period_range(None, "a", "b", now) == {}
    assert periods.period_range("custom", "2024-02-02", "2024-01-01", now) == {"start_date": "2024-01-01", "end_date": "2024-02-02"}
    assert one(spark, periods.period_start(F.lit(now), 7), periods.recent_start(F.lit(now)))[0] == dt.date(2024, 3, 4)


def test_colours(spark):
    assert one(spark, S.swir_rgba(F.lit(5000), F.lit(0), F.lit(1)), S.swir_rgba(F.lit(5000), F.lit(1000), F.lit(3000)))[0] == [0, 0, 0, 0]
    assert one(spark, S.swir_rgba(F.lit(5000), F.lit(1000), F.lit(3000)))[0] == [255, 0, 155, 255]
    assert one(spark, S.rgba([F.lit(0), F.lit(3)], [F.lit(1), F.lit(2), F.lit(3)], "all"))[0] == [1, 2, 3, 255]
    assert one(spark, S.ndvi_rgba(F.lit(2000), F.lit(4000), F.lit(8)), S.ndvi_rgba(F.lit(0), F.lit(4000), F.lit(4)))[:2] == ([0, 0, 0, 0], [0, 0, 0, 0])


def test_territory(spark):
    s = lambda x: F.lit(x).cast("string")
    inside = lambda lat, lon, name, ru=None: territory.likely_inside(F.lit(lat), F.lit(lon), s(name), s(ru))
    cases = [(53.0, 108.0, "Reserve"), (49.0, 108.0, "Reserve"), (49.0, 108.0, "Reserve", "Парк"), (43.5, 45.0, "Парк"), (69.0, 25.0, "Парк"), (55.0, 30.0, "Park"), (55.0, 30.0, None, "Парк"), (55.0, 60.0, "ნაკრძალი"), (83.0, 60.0, "Парк"), (None, 60.0, "Парк")]
    assert one(spark, *[inside(*c) for c in cases]) == (True, False, True, False, False, False, True, False, False, False)
    assert one(spark, *[territory.tagged_area_ha(s(x)) for x in ("12.5 ha", " 7", "-1", "0", "x", None, "1e2")]) == (12.5, 7.0, None, None, None, None, 100.0)


def test_spaced_records(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(i, "a", at(5 * i), True) for i in range(7)] + [(10, "a", at(31), False), (11, "a", at(36), False), (12, "a", at(41), False), (14, "a", at(42), True), (13, "b", at(1), True)]
    log = spark.createDataFrame(rows, "run_id long, source string, at timestamp, ok boolean")
    written = lambda df: sorted(r.run_id for r in df.where("write").collect())
    assert written(status.spaced(log, ["source"], change="ok")) == [0, 2, 4, 6, 10, 12, 13, 14]
    assert written(status.spaced(log, ["source", "ok"])) == [0, 2, 4, 6, 10, 12, 13, 14]
    near = spark.createDataFrame([(1, "a", at(0), True), (2, "a", at(1), False), (3, "a", at(2), True), (4, "a", at(3), False)], log.schema)
    assert written(status.spaced(near, ["source"], change="ok")) == [1, 2, 3, 4] and written(status.spaced(near, ["source", "ok"])) == [1, 2]
    assert status.spaced(log, ["source"]).count() == len(rows) and status.spaced(log.where("false"), ["source"]).count() == 0


def test_area_of_interest(spark):
    from emberlens.functions import numeric as N

    w, s, e, n = one(spark, *N.expand_aoi(F.lit(104.0), F.lit(52.0), F.lit(104.5), F.lit(52.001)))
    assert (n - s) * N.KM_PER_DEG_LAT_AOI == pytest.approx(20) and (e - w) * N.KM_PER_DEG * np.cos(np.radians(52.0005)) == pytest.approx(20)

"""Column helpers against values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberlens.functions import numeric as N, spectral as S, text as T


@pytest.fixture
def value(spark):
    def get(*columns):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return get


def lit(x):
    return F.lit(x)


def test_rounding(value):
    assert value(*[N.js_round(F.lit(x), d) for x, d in ((2.5, 0), (-2.5, 0), (0.125, 2), (-0.5, 0))]) == (3.0, -2.0, 0.13, 0.0)
    assert value(N.safe_div(F.lit(1), F.lit(0)), N.safe_div(F.lit(None).cast("int"), F.lit(2)), N.safe_div(F.lit(1), F.lit(4))) == (None, None, 0.25)


def test_indicators(value):
    assert value(N.per_area(lit(1500), lit(775000.0))) == pytest.approx(19.3548, abs=1e-4)
    assert value(N.loss_per_100k_ha(lit(8470.0), lit(71500.0))) == pytest.approx(11.846, abs=1e-3)
    assert value(N.per_area(lit(1), lit(0.0)), N.loss_per_100k_ha(lit(1.0), lit(None).cast("double")), N.share_percent(lit(3.0), lit(2.0))) == (None, None, 100.0)


def test_distances(value):
    km = N.EARTH_RADIUS_KM * math.pi / 180
    assert value(N.haversine_km(lit(0.0), lit(0.0), lit(1.0), lit(0.0))) == pytest.approx(km)
    assert value(N.haversine_km(lit(0.0), lit(179.5), lit(0.0), lit(-179.5))) == pytest.approx(km)
    assert value(N.bearing_deg(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(90)
    lat, lon = value(*N.destination(lit(52.0), lit(104.0), lit(45.0), lit(10.0)))
    assert value(N.haversine_km(lit(52.0), lit(104.0), lit(lat), lit(lon))) == pytest.approx(10)
    inside = value(N.segment_km(lit(1.0), lit(0.5), lit(0.0), lit(0.0), lit(0.0), lit(1.0)))
    assert inside == pytest.approx(km, rel=1e-6)
    past = value(N.segment_km(lit(0.0), lit(3.0), lit(0.0), lit(0.0), lit(0.0), lit(1.0)))
    assert past == pytest.approx(2 * km)
    boxes = [{k: lit(v) for k, v in b.items()} for b in ({"s": 0.0, "w": 0.0, "n": 1.0, "e": 1.0}, {"s": 2.0, "w": 0.5, "n": 3.0, "e": 4.0}, {"s": 0.5, "w": 0.5, "n": 5.0, "e": 5.0})]
    assert value(N.bbox_distance_km(boxes[0], boxes[1]), N.bbox_distance_km(boxes[0], boxes[2])) == (pytest.approx(km), 0.0)


def test_segment_against_samples(value):
    for lat, lon in ((52.1, 104.3), (52.6, 104.9), (51.9, 103.9)):
        n = 4000
        best = min(
            2 * N.EARTH_RADIUS_KM * math.asin(math.sqrt(math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(lat)) * math.sin(math.radians(b - lon) / 2) ** 2))
            for a, b in ((52.0 + 0.5 * i / n, 104.0 + 0.8 * i / n) for i in range(n + 1))
        )
        assert value(N.segment_km(lit(lat), lit(lon), lit(52.0), lit(104.0), lit(52.5), lit(104.8))) == pytest.approx(best, rel=2e-2, abs=0.05)


def test_grids(value):
    assert value(N.pixel_area_ha(lit(2))) == 28.12
    row = value(N.heat_row(lit(57.123)))
    col = value(N.heat_col(lit(row), lit(107.2)))
    lat, lon = value(*N.heat_centre(lit(row), lit(col)))
    assert abs(lat - 57.123) <= 0.002 and abs(lon - 107.2) * math.cos(math.radians(lat)) <= 0.0021
    assert value(N.wrap_lon(lit(190.0)), N.lon_delta(lit(-179.0), lit(179.0))) == (-170.0, 2.0)
    w, s, e, n = value(*N.expand_aoi(lit(104.0), lit(52.0), lit(104.001), lit(52.001)))
    assert (n - s) * N.KM_PER_DEG_LAT_AOI == pytest.approx(3) and (e - w) * N.KM_PER_DEG * math.cos(math.radians(52.0005)) == pytest.approx(3)


def test_confidence_and_times(value):
    codes = {"h": "high", " Nominal": "nominal", "l": "low", "80": "high", "30": "nominal", "29.9": "low", "x": None, "": None, None: None}
    assert value(*[T.normalize_confidence(F.lit(c).cast("string")) for c in codes]) == tuple(codes.values())
    assert value(*[T.sql_time(F.lit(t).cast("string")) for t in ("512", "2359", "2400", "1260", "x", None, "0")]) == ("05:12:00", "23:59:00", None, None, None, None, "00:00:00")
    assert value(T.acquired_at(lit("2024-02-30"), lit("0512")), T.acquired_at(lit("2024-02-29"), lit("0512"))) == (None, dt.datetime(2024, 2, 29, 5, 12))


def test_statistics_text(value):
    assert value(*[T.statistics_number(F.lit(x).cast("string")) for x in ("1 234,5", "1234.5", "-", "н/д", "", None, "1e3", "1 2 3")]) == (1234.5, 1234.5, None, None, None, None, 1000.0, 123.0)
    assert value(T.normalize_region_name(lit("  «Республика  Саха»( Якутия ) ."))) == "республика саха (якутия)"
    assert value(T.normalize_region_name(lit("Ханты–Мансийский автономный округ — Югра"))) == "ханты-мансийский автономный округ-югра"
    assert value(T.strip_parens(lit("республика саха (якутия)")), T.strip_city_prefix(lit("г. москва"))) == ("республика саха", "москва")
    assert value(T.first_filled(lit(""), lit(None).cast("string"), lit("b"))) == "b"


def test_csv_and_labels(value):
    cells = {"a": "a", 'a"b': '"a""b"', "a,b": '"a,b"', "=1": "'=1", "-1": "'-1", None: ""}
    assert value(*[T.csv_cell(F.lit(c).cast("string")) for c in cells]) == tuple(cells.values())
    assert value(T.csv_cell(lit(-1), False)) == "-1"
    assert value(*[T.compass_words(lit(float(b))) for b in (0, 22.4, 22.5, 359, 180)]) == ("north", "north", "north-east", "north", "south")
    assert value(T.ascii_json(lit("aЖ😀"))) == "a\\u0416\\ud83d\\ude00"
    assert value(T.looks_like_markup(lit(" <html>")), T.looks_like_markup(lit("{}")), T.is_png(F.lit(bytearray(b"\x89PNG\r\n\x1a\nrest")))) == (True, False, True)
    today = F.lit(dt.date(2024, 6, 1))
    assert value(*[T.distribution_problem(lit(v), today) for v in ("v20240131", "20240131", "v20240231", "v20240701", "v20220101")]) == (None, "format", "not a day", "in the future", "too old")


def test_requests():
    assert [T.iso_date(x) for x in ("2024-02-29", "2023-02-29", ["2024-01-01"], 5, "2024-1-1")] == ["2024-02-29", None, "2024-01-01", None, None]
    assert [T.clamp_limit(x) for x in ("5.9", "9999", "nan", None, "-3")] == [5, 100, 12, 12, 1]
    assert [T.clamp_offset(x) for x in ("7", "-1", "x")] == [7, 0, 0]
    assert [T.bounded_int(x, 1, 30, 10) for x in ("30", "31", "1.5", None)] == [30, 10, 10, 10]


def test_spectral(value):
    v = value(S.ndvi(lit(0.5), lit(0.1)), S.nbr(lit(0.4), lit(0.0)), S.evi(lit(0.05), lit(0.1), lit(0.5)), S.dnbr(lit(0.5), lit(-0.2)), S.ndvi(lit(0.0), lit(0.0)))
    assert [tuple(x) for x in v] == [(0.6667, "very_dense_vegetation", True), (0.0, "no_data", False), (0.5797, "dense_vegetation", True), (0.7, "high_severity", False), (0.0, "no_data", False)]
    assert value(S.normalized_difference(lit(0.0), lit(0.0)), S.reflectance(lit(0)), S.severity(lit(0.3)), S.severity(lit(None).cast("double"))) == (None, None, "moderate_low", None)
    assert value(S.ndvi_color(lit(-1.0))) == [165, 0, 38] and value(S.ndvi_color(lit(2.0))) == [0, 104, 55]
    assert tuple(value(S.decode_disturbance(lit(2), lit(10), lit(230)))) == (520, 2)

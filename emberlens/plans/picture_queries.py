"""Queries on projections, picture grids, time spans, colours and protected areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlens.functions import numeric as N, periods, projection as P, spectral as S, territory
from emberlens.operators import raster
from emberlens.plans import views as V
from emberlens.plans.views import PIXELS_SQL, jr, query, rad
from emberlens.session import table


def utm_sql(points: str) -> str:
    """CTE utm: the rows of ``points`` (lat, lon, epsg, ...) with x and y."""
    east = " + ".join(f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(P.SERIES, 1))
    north = " + ".join(f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(P.SERIES, 1))
    k = f"{P.SCALE * P.RADIUS_M!r}::DOUBLE"
    e = f"{P.ECCENTRICITY!r}::DOUBLE"
    return f"""u1 AS (SELECT *, epsg BETWEEN 32601 AND 32660 OR epsg BETWEEN 32701 AND 32760 AS ok, {rad('lon - ((epsg % 100) * 6 - 183)')} AS turn, sin({rad('lat')}) AS sine FROM {points}),
u2 AS (SELECT *, sinh(atanh(sine) - {e} * atanh({e} * sine)) AS t FROM u1),
u3 AS (SELECT *, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(t * t + 1)) AS eta FROM u2),
utm AS (SELECT * EXCLUDE (turn, sine, t, xi, eta), CASE WHEN ok THEN {k} * (eta + {east}) + 500000 END AS x, CASE WHEN ok THEN {k} * (xi + {north}) + CASE WHEN epsg >= 32700 THEN 10000000 ELSE 0 END END AS y FROM u3)"""


PLACES_SQL = """p AS (SELECT c_custkey AS id, (c_custkey % 161 - 80) * 0.9::DOUBLE AS lat, 80 + (c_custkey % 89) * 0.37::DOUBLE AS lon,
  CASE WHEN c_custkey % 17 = 0 THEN 4326 WHEN c_custkey % 161 < 80 THEN 32700 ELSE 32600 END + CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE floor((80 + (c_custkey % 89) * 0.37::DOUBLE) / 6)::INT + 31 END AS epsg FROM customer)"""


@query(f"WITH {PLACES_SQL}, {utm_sql('p')} SELECT id, {jr('x', 3)} AS x, {jr('y', 3)} AS y FROM utm")
def utm_projection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lon = (k % 89) * 0.37 + 80.0
    epsg = F.when(k % 17 == 0, 4326).otherwise(F.when(k % 161 < 80, 32700).otherwise(32600) + F.floor(lon / 6).cast("int") + 31)
    p = table(spark, d, "customer").select(k.alias("id"), P.utm((k % 161 - 80) * 0.9, lon, epsg).alias("p"))
    return p.select("id", N.js_round("p.x", 3).alias("x"), N.js_round("p.y", 3).alias("y"))


AOI_SQL = """b AS (SELECT p_partkey AS id, 104 + (p_partkey % 40) * 0.1::DOUBLE AS w, 50 + (p_partkey % 23) * 0.3::DOUBLE AS s, p_size * 0.008::DOUBLE AS dx, (p_partkey % 11) * 0.02::DOUBLE AS dy FROM part),
c AS (SELECT id, (w + w + dx) / 2 AS lon, (s + s + dy) / 2 AS lat, greatest(3, (w + dx - w) * (cos(((s + s + dy) / 2) * pi() / 180) * 111.32::DOUBLE) * 1.2::DOUBLE) AS wide, greatest(3, (s + dy - s) * 110.574::DOUBLE * 1.2::DOUBLE) AS high FROM b),
m AS (SELECT id, lon, lat, CASE WHEN greatest(wide, high) > 20 THEN 20 ELSE wide END / 2 / (cos(lat * pi() / 180) * 111.32::DOUBLE) AS hx, CASE WHEN greatest(wide, high) > 20 THEN 20 ELSE high END / 2 / 110.574::DOUBLE AS hy FROM c)"""
LEVELS = [10.0, 20.0, 40.0, 80.0]


@query(f"""WITH {AOI_SQL}, a AS (SELECT id, {jr('lon - hx', 5)} AS w, {jr('lat - hy', 5)} AS s, {jr('lon + hx', 5)} AS e, {jr('lat + hy', 5)} AS n FROM m),
i AS (SELECT a.*, k / 8::DOUBLE AS t FROM a, range(9) r(k)),
q AS (SELECT id, 32648 AS epsg, lat, lon FROM (SELECT id, s AS lat, w + (e - w) * t AS lon FROM i UNION ALL SELECT id, n, w + (e - w) * t FROM i UNION ALL SELECT id, s + (n - s) * t, w FROM i UNION ALL SELECT id, s + (n - s) * t, e FROM i)),
{utm_sql('q')}, x AS (SELECT id, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM utm GROUP BY id),
z AS (SELECT *, greatest(10::DOUBLE, greatest(e - w, n - s) / 512) AS pixel FROM x),
g AS (SELECT *, greatest(1, least(512, ceil((e - w) / pixel - 1e-9::DOUBLE)))::INT AS width, greatest(1, least(512, ceil((n - s) / pixel - 1e-9::DOUBLE)))::INT AS height FROM z),
l AS (SELECT id, pixel, width, height, (w + e) / 2 - width * pixel / 2 AS w, (w + e) / 2 + width * pixel / 2 AS e, (s + n) / 2 - height * pixel / 2 AS s, (s + n) / 2 + height * pixel / 2 AS n,
  CASE WHEN pixel >= 40 - 1e-6::DOUBLE THEN 2 WHEN pixel >= 20 - 1e-6::DOUBLE THEN 1 ELSE 0 END AS level FROM g),
v AS (SELECT *, 10 * power(2, level) AS r, (10980 / power(2, level))::INT AS side FROM l),
o AS (SELECT *, greatest(0, floor((w - 300000) / r)) AS x0, least(side, ceil((e - 300000) / r)) AS x1, greatest(0, floor((6000000 - n) / r)) AS y0, least(side, ceil((6000000 - s) / r)) AS y1 FROM v)
SELECT id, {jr('w', 2)} AS w, {jr('n', 2)} AS n, width, height, {jr('pixel', 4)} AS pixel, level::INT AS level, CASE WHEN x1 > x0 AND y1 > y0 THEN x0::BIGINT END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y1::BIGINT END AS y1 FROM o""")
def picture_grids(spark: SparkSession, d: str) -> DataFrame:
    """Box of an incident -> area shown, its zone's envelope, the picture's grid, the overview to read and the pixels to read of it."""
    k = F.col("p_partkey")
    w, s = (k % 40) * 0.1 + 104.0, (k % 23) * 0.3 + 50.0
    box = dict(zip("wsen", N.expand_aoi(w, s, w + F.col("p_size") * 0.008, s + (k % 11) * 0.02), strict=True))
    a = table(spark, d, "part").select(k.alias("id"), *[N.js_round(c, 5).alias(n) for n, c in box.items()])
    g = raster.project_boxes(a, ["id"], F.lit(32648)).select("id", P.plan_grid(F.col("box")).alias("grid"))
    g = g.withColumn("level", P.pick_level(F.array(*[F.lit(r) for r in LEVELS[:3]]), F.col("grid.pixel")))
    factor = F.pow(F.lit(2.0), F.col("level"))
    g = g.withColumn("win", P.pixel_window(F.col("grid"), F.lit(300000.0), F.lit(6000000.0), factor * 10, (F.lit(10980) / factor).cast("int"), (F.lit(10980) / factor).cast("int")))
    return g.select("id", N.js_round("grid.w", 2).alias("w"), N.js_round("grid.n", 2).alias("n"), "grid.width", "grid.height", N.js_round("grid.pixel", 4).alias("pixel"), "level", "win.x0", "win.y1")


def _swir_sql(b: str) -> str:
    return jr(f"pow(greatest(0, least(1, ({b} * 0.0001::DOUBLE - 0.01) / 0.4::DOUBLE)), 1 / 1.4::DOUBLE) * 255") + "::INT"


@query(f"WITH {PIXELS_SQL} SELECT l_orderkey, l_linenumber, {', '.join(f'CASE WHEN b12 = 0 OR b8 = 0 OR b4 = 0 THEN 0 ELSE {_swir_sql(b)} END AS {c}' for c, b in (('r', 'b12'), ('g', 'b8'), ('b', 'b4')))}, CASE WHEN b12 = 0 OR b8 = 0 OR b4 = 0 THEN 0 ELSE 255 END AS a FROM px")
def swir_picture(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d).withColumn("c", S.swir_rgba("b12", "b8", "b4", 0.0001, -0.01))
    return p.select("l_orderkey", "l_linenumber", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgba")])


SPANS_SQL = "o AS (SELECT o_orderkey AS id, o_orderdate AS first_seen, o_orderdate + to_days((o_orderkey % 90)::INT) AS last_seen, year(o_orderdate)::INT AS y FROM orders), n AS (SELECT max(o_orderdate) AS t FROM orders)"
STAMP = "'%Y-%m-%d %H:%M:%S'"


@query(f"""WITH {SPANS_SQL} SELECT id, strftime(first_seen - INTERVAL 60 DAY, {STAMP}) AS before_start, strftime(first_seen - INTERVAL 1 DAY, {STAMP}) AS before_end,
  CASE WHEN last_seen + INTERVAL 1 SECOND < t THEN strftime(last_seen + INTERVAL 1 SECOND, {STAMP}) END AS after_start,
  strftime(CASE WHEN t < make_timestamp(y, 8, 31, 23, 59, 59.999) THEN t ELSE make_timestamp(y, 8, 31, 23, 59, 59) END, {STAMP}) AS summer_end, t < make_timestamp(y, 8, 31, 23, 59, 59.999) AS partial,
  len(range(1990, CASE WHEN last_seen >= make_timestamp(year(last_seen), 7, 1, 0, 0, 0) THEN year(last_seen) ELSE year(last_seen) - 1 END + 1))::INT AS years FROM o, n""")
def scene_windows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("first_seen"))
    as_of = F.lit(o.agg(F.max("first_seen")).first()[0])
    o = o.withColumn("last_seen", F.col("first_seen") + F.make_dt_interval((F.col("id") % 90).cast("int")))
    year, stamp = F.year("first_seen"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    before, after = periods.before_window(F.col("first_seen")), periods.after_window(F.col("last_seen"), as_of)
    return o.select(
        "id", stamp(before["start"]).alias("before_start"), stamp(before["end"]).alias("before_end"), stamp(after["start"]).alias("after_start"),
        stamp(periods.search_window(year, as_of)["end"]).alias("summer_end"), periods.is_partial(year, as_of).alias("partial"), F.size(periods.series_years(F.col("last_seen"), 1990)).alias("years"),
    )


NAMES = ["Заповедник", "Reserve", "ნაკრძალი", "Արգելոց"]


@query(f"""WITH a AS (SELECT s_suppkey * 1000 + n_nationkey AS id, 38 + (s_suppkey * 7 + n_nationkey) % 48 AS lat, 15 + (s_suppkey * 13 + n_nationkey * 5) % 168 AS lon, {NAMES!r}[((s_suppkey + n_nationkey) % 4 + 1)::INT] AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Парк' END AS ru, CASE s_suppkey % 4 WHEN 0 THEN '12.5 ha' WHEN 1 THEN '-3' WHEN 2 THEN 'x' ELSE '1e2' END AS tag FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey),
c AS (SELECT *, regexp_matches(name, '[Ѐ-ӿ]') OR coalesce(regexp_matches(ru, '[Ѐ-ӿ]'), false) AS cyr FROM a)
SELECT id, coalesce(ru, name) AS name, CASE tag WHEN '12.5 ha' THEN 12.5 WHEN '1e2' THEN 100 ELSE 7 END::DOUBLE AS area_ha,
  lat BETWEEN 41 AND 82 AND lon BETWEEN 19 AND 180 AND NOT regexp_matches(name, '[Ⴀ-ჿ]|[԰-֏]') AND NOT (lat < 44 AND lon BETWEEN 37 AND 51) AND NOT (lat > 68 AND lon < 26)
  AND (cyr OR NOT (lat < 50 OR (lat < 60 AND lon < 37))) AS inside FROM c""")
def protected_areas(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    a = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") % 5 == F.col("n_regionkey")).select(
        (s * 1000 + n).alias("id"), ((s * 7 + n) % 48 + 38).cast("double").alias("lat"), ((s * 13 + n * 5) % 168 + 15).cast("double").alias("lon"), F.lit(7.0).alias("computed_ha"),
        F.create_map(F.lit("name"), F.get(F.array(*[F.lit(x) for x in NAMES]), ((s + n) % 4).cast("int")), F.lit("name:ru"), F.when(s % 3 == 0, "Парк"),
                     F.lit("area:ha"), F.get(F.array(*[F.lit(x) for x in ("12.5 ha", "-3", "x", "1e2")]), (s % 4).cast("int"))).alias("tags"),
    )
    a = a.withColumn("inside", territory.likely_inside("lat", "lon", F.col("tags")["name"], F.col("tags")["name:ru"]))
    return a.select("id", "inside", *territory.area_features()).select("id", "name", "area_ha", "inside")

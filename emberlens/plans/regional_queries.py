"""Queries on regions: spatial joins, archive counts, official statistics, indicators, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlens.functions import numeric as N, text as T
from emberlens.operators import context, geometry, official, protected, regional as R, spatial
from emberlens.operators.ranges import running_sums
from emberlens.plans import views as V
from emberlens.plans.views import EDGES_SQL, H_SQL, hav, jr, pip_sql, query, rad
from emberlens.session import table
from emberlens.sources import readers


# ---- spatial joins
@query(f"WITH {H_SQL}, {EDGES_SQL}, {pip_sql('h')} SELECT id, region FROM first_region")
def point_in_polygon_holes(spark: SparkSession, d: str) -> DataFrame:
    return spatial.first_region(V.hotspots(spark, d), spatial.edges_of(V.regions(spark, d)))


NRT_SQL = "cells AS (SELECT round(lat::DECIMAL(9, 6), 2) AS cell_lat, round(lon::DECIMAL(9, 6), 2) AS cell_lon, count(*) AS n, max(acquired_at)::DATE AS last_day FROM h GROUP BY 1, 2)"


@query(f"WITH {H_SQL}, {NRT_SQL} SELECT cell_lat::DOUBLE AS cell_lat, cell_lon::DOUBLE AS cell_lon, n, strftime(last_day, '%Y-%m-%d') AS last_day FROM cells")
def nrt_grid_counts(spark: SparkSession, d: str) -> DataFrame:
    c = R.nrt_cells(V.hotspots(spark, d))
    return c.select(F.col("cell_lat").cast("double").alias("cell_lat"), F.col("cell_lon").cast("double").alias("cell_lon"), "n", F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


@query(f"""WITH {H_SQL}, {NRT_SQL}, pc AS (SELECT row_number() OVER (ORDER BY cell_lat, cell_lon) AS id, cell_lat::DOUBLE AS lat, cell_lon::DOUBLE AS lon, n FROM cells), {EDGES_SQL}, {pip_sql('pc')}
SELECT r_name AS region, coalesce(sum(n), 0)::BIGINT AS n FROM region LEFT JOIN (SELECT region, n FROM first_region JOIN pc USING (id)) x ON x.region = r_name GROUP BY 1""")
def region_counts_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    r = V.regions(spark, d)
    return R.counts_by_region(R.nrt_cells(V.hotspots(spark, d)), spatial.edges_of(r), r)


AREAS_SQL = "areas AS (SELECT r_name AS region, 100 - r_regionkey AS area FROM region)"
PLACES_SQL = "p AS (SELECT c_custkey AS id, 49::DOUBLE + (c_custkey % 97) * 0.1::DOUBLE AS lat, 94::DOUBLE + (c_custkey % 89) * 0.25::DOUBLE AS lon FROM customer)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (F.lit(49.0) + (k % 97) * 0.1).alias("lat"), (F.lit(94.0) + (k % 89) * 0.25).alias("lon"))


def _boundary_sql() -> str:
    k = f"(pi() / 180 * {N.PROXIMITY_RADIUS_KM}::DOUBLE)"
    x = lambda c: f"((({c} - p.lon) + 540 - 360 * floor((({c} - p.lon) + 540) / 360)) - 180) * cos({rad('p.lat')}) * {k}"
    return f"""flat AS (SELECT p.id, e.region, e.ord, {x('e.x1')} AS ax, (e.y1 - p.lat) * {k} AS ay, {x('e.x2')} AS bx, (e.y2 - p.lat) * {k} AS by_ FROM p, edges e),
seg AS (SELECT *, (bx - ax) AS dx, (by_ - ay) AS dy FROM flat),
prj AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM seg),
far AS (SELECT id, region, ord, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS km FROM prj),
near AS (SELECT id, arg_min(region, (km, ord)) AS region, min(km) AS km FROM far WHERE km <= 50 GROUP BY id)"""


@query(f"""WITH {PLACES_SQL}, {EDGES_SQL}, {AREAS_SQL}, {pip_sql('p')}, {_boundary_sql()},
inn AS (SELECT id, arg_min(region, (area, ord)) AS region FROM inside JOIN areas USING (region) GROUP BY id)
SELECT p.id, CASE WHEN inn.id IS NOT NULL THEN 'inside' WHEN near.id IS NOT NULL THEN 'near' ELSE 'none' END AS relation, coalesce(inn.region, near.region) AS region,
  CASE WHEN inn.id IS NOT NULL THEN 0 ELSE {jr('near.km', 6)} END AS km FROM p LEFT JOIN inn USING (id) LEFT JOIN near USING (id)""")
def nearest_area_or_inside(spark: SparkSession, d: str) -> DataFrame:
    r = V.regions(spark, d)
    areas = r.select("region", (F.lit(100) - F.col("ord")).alias("area"))
    return spatial.area_relation(_places(spark, d), spatial.edges_of(r), areas).withColumn("km", N.js_round("km", 6))


ROADS_SQL = """roads AS (SELECT s_suppkey AS ord, s_name AS name, 50::DOUBLE + (s_suppkey % 41) * 0.2::DOUBLE AS lat1, 95::DOUBLE + (s_suppkey % 37) * 0.5::DOUBLE AS lon1,
  50::DOUBLE + (s_suppkey % 41) * 0.2::DOUBLE + 0.1::DOUBLE AS lat2, 95::DOUBLE + (s_suppkey % 37) * 0.5::DOUBLE + 0.3::DOUBLE AS lon2 FROM supplier)"""


def _roads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lat, lon = F.lit(50.0) + (k % 41) * 0.2, F.lit(95.0) + (k % 37) * 0.5
    return table(spark, d, "supplier").select(k.alias("ord"), F.col("s_name").alias("name"), lat.alias("lat1"), lon.alias("lon1"), (lat + 0.1).alias("lat2"), (lon + 0.3).alias("lon2"))


def _segment_sql() -> str:
    r = f"{N.EARTH_RADIUS_KM}::DOUBLE"

    def bearing(a: str, b: str, c: str, e: str) -> str:
        y = f"sin({rad(e)} - {rad(b)}) * cos({rad(c)})"
        x = f"cos({rad(a)}) * sin({rad(c)}) - sin({rad(a)}) * cos({rad(c)}) * cos({rad(e)} - {rad(b)})"
        return f"(atan2({y}, {x}) * 180 / pi())"

    return f"""leg AS (SELECT p.id, o.ord, o.name, {hav('o.lat1', 'o.lon1', 'p.lat', 'p.lon')} AS a, {hav('o.lat2', 'o.lon2', 'p.lat', 'p.lon')} AS b, {hav('o.lat1', 'o.lon1', 'o.lat2', 'o.lon2')} / {r} AS len,
  {rad(bearing('o.lat1', 'o.lon1', 'p.lat', 'p.lon'))} - {rad(bearing('o.lat1', 'o.lon1', 'o.lat2', 'o.lon2'))} AS turn FROM p, roads o WHERE abs(p.lat - o.lat1) < 1),
road_km AS (SELECT id, ord, name, CASE WHEN len = 0 OR atan2(sin(a / {r}) * cos(turn), cos(a / {r})) <= 0 THEN a WHEN atan2(sin(a / {r}) * cos(turn), cos(a / {r})) >= len THEN b
  ELSE abs(asin(greatest(-1::DOUBLE, least(1::DOUBLE, sin(a / {r}) * sin(turn))))) * {r} END AS km FROM leg)"""


@query(f"WITH {PLACES_SQL}, {ROADS_SQL}, {_segment_sql()} SELECT id, {jr('min(km)', 4)} AS km, arg_min(name, (km, ord)) AS name FROM road_km WHERE km <= 15 GROUP BY id")
def nearest_road_segment(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_segment(_places(spark, d), _roads(spark, d), 15.0, ["name"]).withColumn("km", N.js_round("km", 4))


@query(f"WITH {PLACES_SQL}, {ROADS_SQL} SELECT p.id, {jr('min(' + hav('p.lat', 'p.lon', 'o.lat1', 'o.lon1') + ')', 6)} AS km, arg_min(o.name, ({hav('p.lat', 'p.lon', 'o.lat1', 'o.lon1')}, o.ord)) AS name FROM p, roads o WHERE {hav('p.lat', 'p.lon', 'o.lat1', 'o.lon1')} <= 15 GROUP BY p.id")
def nearest_settlement(spark: SparkSession, d: str) -> DataFrame:
    towns = _roads(spark, d).select(F.col("ord").alias("id"), "ord", "name", F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))
    return spatial.nearest_point(_places(spark, d), towns, 15.0, ["name"]).withColumn("km", N.js_round("km", 6))


# the same places, roads and areas, turned so that the antimeridian runs through them
EAST = 78
TURN = "CASE WHEN {0} + 78 > 180 THEN {0} + 78 - 360 ELSE {0} + 78 END"


def _turned(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) + EAST > 180, F.col(c) + EAST - 360.0).otherwise(F.col(c) + EAST) for c in columns})


TURNED_PLACES_SQL = PLACES_SQL.replace("p AS (", "p0 AS (") + f", p AS (SELECT id, lat, {TURN.format('lon')} AS lon FROM p0)"
TURNED_ROADS_SQL = ROADS_SQL.replace("roads AS (", "roads0 AS (") + f", roads AS (SELECT * REPLACE ({TURN.format('lon1')} AS lon1, {TURN.format('lon2')} AS lon2) FROM roads0)"


@query(f"WITH {TURNED_PLACES_SQL}, {TURNED_ROADS_SQL}, {_segment_sql()} SELECT id, {jr('min(km)', 4)} AS km, arg_min(name, (km, ord)) AS name FROM road_km WHERE km <= 15 GROUP BY id")
def nearest_road_across(spark: SparkSession, d: str) -> DataFrame:
    """Roads and places on both sides of the antimeridian, some roads across it."""
    roads = _turned(_roads(spark, d), "lon1", "lon2")
    return spatial.nearest_segment(_turned(_places(spark, d), "lon"), roads, 15.0, ["name"]).withColumn("km", N.js_round("km", 4))


@query(f"""WITH {TURNED_PLACES_SQL}, {EDGES_SQL.replace("edges AS (", "edges0 AS (")}, edges AS (SELECT * REPLACE (x1 + 78 AS x1, x2 + 78 AS x2) FROM edges0), {AREAS_SQL}, {pip_sql('p')}, {_boundary_sql()},
inn AS (SELECT id, arg_min(region, (area, ord)) AS region FROM inside JOIN areas USING (region) GROUP BY id)
SELECT p.id, CASE WHEN inn.id IS NOT NULL THEN 'inside' WHEN near.id IS NOT NULL THEN 'near' ELSE 'none' END AS relation, coalesce(inn.region, near.region) AS region,
  CASE WHEN inn.id IS NOT NULL THEN 0 ELSE {jr('near.km', 6)} END AS km FROM p LEFT JOIN inn USING (id) LEFT JOIN near USING (id)""")
def nearest_area_across(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries that run past 180 degrees, and places around them on both sides."""
    r = V.regions(spark, d)
    edges = spatial.edges_of(r).withColumns({"x1": F.col("x1") + EAST, "x2": F.col("x2") + EAST})
    return spatial.area_relation(_turned(_places(spark, d), "lon"), edges, r.select("region", (F.lit(100) - F.col("ord")).alias("area"))).withColumn("km", N.js_round("km", 6))


def _context_sql() -> str:
    km = hav("q.lat", "q.lon", "o.lat1", "o.lon1")
    best = lambda where: f"(SELECT id, {jr('min(km)', 4)} AS km, arg_min(name, (km, ord)) AS name FROM road_km WHERE km <= 15 AND {where} GROUP BY id)"
    return f"""WITH {PLACES_SQL.replace('p AS (', 'p0 AS (')}, p AS (SELECT id, {jr('lat', 3)} AS lat, {jr('lon', 3)} AS lon FROM p0), {ROADS_SQL}, {_segment_sql()},
t AS (SELECT q.id, {jr(f'min({km})', 4)} AS km, arg_min(o.name, ({km}, o.ord)) AS name FROM p q, roads o WHERE {km} <= 15 GROUP BY q.id)
SELECT p.id, p.lat, p.lon, a.km AS road_km, a.name AS road, b.km AS paved_km, b.name AS paved, c.km AS track_km, c.name AS track, t.km AS settlement_km, t.name AS settlement
FROM p LEFT JOIN {best('ord % 3 > 0')} a ON a.id = p.id LEFT JOIN {best('ord % 3 = 1')} b ON b.id = p.id LEFT JOIN {best('ord % 3 = 0')} c ON c.id = p.id LEFT JOIN t ON t.id = p.id"""


@query(_context_sql())
def incident_context(spark: SparkSession, d: str) -> DataFrame:
    """The surroundings of each place; a third of the roads are tracks, a third paved."""
    k = F.col("ord") % 3
    roads = _roads(spark, d).withColumns({"track": k == 0, "paved": k == 1})
    towns = roads.select(F.col("ord").alias("id"), "ord", "name", F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))
    out = context.incident_context(_places(spark, d), roads, towns, F.lit(None).cast("string"), F.lit("2024-01-01"))
    found = {"road": "road", "paved_road": "paved", "track": "track", "settlement": "settlement"}
    return out.select("id", "lat", "lon", *[c for name, short in found.items() for c in (N.js_round(F.col(name)["km"], 4).alias(f"{short}_km"), F.col(name)["name"].alias(short))])


# ---- areas
@query("""WITH t AS (SELECT p_size % 7 AS key, (p_partkey * 37) % 1000 AS low, (p_partkey * 37) % 1000 + p_size % 9 AS high FROM part),
s AS (SELECT *, max(high) OVER (PARTITION BY key ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
g AS (SELECT *, sum((reach IS NULL OR low > reach)::INT) OVER (PARTITION BY key ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM s),
m AS (SELECT key, min(low) AS low, max(high) AS high FROM g GROUP BY key, island)
SELECT m.key, sum(greatest(0, least(m.high, q.hi) - greatest(m.low, q.lo)))::DOUBLE AS length FROM m, (SELECT i * 100 AS lo, i * 100 + 50 AS hi FROM range(10) r(i)) q GROUP BY m.key""")
def interval_union_overlap(spark: SparkSession, d: str) -> DataFrame:
    low = (F.col("p_partkey") * 37) % 1000
    t = table(spark, d, "part").select((F.col("p_size") % 7).alias("key"), low.alias("low"), (low + F.col("p_size") % 9).alias("high"))
    marks = t.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("key", (F.col("i") * 100).cast("long").alias("low"), (F.col("i") * 100 + 50).cast("long").alias("high"))
    return spatial.overlap_length(spatial.merge_intervals(t, ["key"]), marks, ["key"]).withColumn("length", F.col("length").cast("double"))


@query(f"""WITH {EDGES_SQL}, cut AS (
  SELECT region, r AS rw, (x2 - x1) * ((r + 0.5) * 0.02::DOUBLE - y1) / (y2 - y1) + x1 AS x FROM edges, range(2500, 3000) q(r) WHERE (y1 > (r + 0.5) * 0.02::DOUBLE) <> (y2 > (r + 0.5) * 0.02::DOUBLE)),
o AS (SELECT *, row_number() OVER w AS k, lead(x) OVER w AS high FROM cut WINDOW w AS (PARTITION BY region, rw ORDER BY x))
SELECT region, {jr(f"sum({rad('greatest(0, least(high, 105) - greatest(x, 100))')} * (sin({rad('rw * 0.02::DOUBLE + 0.02::DOUBLE')}) - sin({rad('rw * 0.02::DOUBLE')})) * pow({N.AREA_RADIUS_KM}::DOUBLE, 2))", 3)} AS km2
FROM o WHERE k % 2 = 1 AND high IS NOT NULL AND rw >= 2550 AND rw < 2700 GROUP BY region HAVING km2 > 0""")
def scanline_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of the regions that two overlapping boxes (100 to 105 east, 51 to 54 north, cut at 53) cover."""
    ring = lambda s, n: [{"lon": x, "lat": y} for x, y in ((100.0, s), (105.0, s), (105.0, n), (100.0, n), (100.0, s))]
    boxes = spark.createDataFrame([("a", 0, [[ring(51.0, 53.0)]]), ("b", 1, [[ring(52.0, 54.0)]])], "region string, ord int, polygons array<array<array<struct<lon: double, lat: double>>>>")
    out = spatial.covered_area_km2(spatial.edges_of(boxes), spatial.edges_of(V.regions(spark, d)))
    return out.where("km2 > 0").withColumn("km2", N.js_round("km2", 3))


@query(f"""WITH {EDGES_SQL}, ring_km2 AS (SELECT region, ring, abs(sum({rad('x2 - x1')} * (2 + sin({rad('y1')}) + sin({rad('y2')})))) * pow({N.AREA_RADIUS_KM}::DOUBLE, 2) / 2 AS km2 FROM edges GROUP BY ALL)
SELECT region, {jr('sum(CASE WHEN ring = 0 THEN km2 ELSE -km2 END)', 3)} AS km2 FROM ring_km2 GROUP BY region""")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return geometry.area_km2(spatial.edges_of(V.regions(spark, d))).withColumn("km2", N.js_round("km2", 3))


@query(f"""WITH {EDGES_SQL} SELECT ord::BIGINT AS relation, 0 AS polygon, ring, (count(*) + 1)::INT AS points, {jr('abs(sum(x1 * y2 - x2 * y1)) / 2', 6)} AS area FROM edges GROUP BY ord, ring""")
def ring_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Regions' rings cut into ways of two or three points, every second one reversed, and put together again."""
    e = spatial.edges_of(V.regions(spark, d))
    way = F.array(F.struct(F.col("x1").alias("lon"), F.col("y1").alias("lat")), F.struct(F.col("x2").alias("lon"), F.col("y2").alias("lat")))
    ways = e.select(F.col("ord").cast("long").alias("relation"), F.xxhash64("x1", "y1").alias("ord"), F.when(F.col("hole"), "inner").otherwise("outer").alias("role"), F.when(F.xxhash64("x2") % 2 == 0, F.reverse(way)).otherwise(way).alias("points"))
    turns = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    area = F.abs(F.aggregate(turns, F.lit(0.0), lambda x, y: x + y)) / 2
    return geometry.assemble_rings(ways).select("relation", "polygon", "ring", F.size("points").alias("points"), N.js_round(area, 6).alias("area"))


@query(None)
def simplify(spark: SparkSession, d: str) -> DataFrame:
    """Rings of many vertices around each region, thinned out to 300 at most."""
    angle = F.sequence(F.lit(0), F.lit(2000))
    point = F.transform(angle, lambda i: F.struct((F.lit(100.0) + F.cos(i % 2000 * 0.0031415926535898) * (5.0 + (i % 7) * 0.01)).alias("lon"), (F.lit(55.0) + F.sin(i % 2000 * 0.0031415926535898) * (3.0 + (i % 5) * 0.01)).alias("lat")))
    out = geometry.simplify_rings(table(spark, d, "region").select("r_name", point.alias("points")))
    return out.select("r_name", F.size("points").alias("vertices"), (F.element_at("points", 1) == F.element_at("points", -1)).alias("closed"))


@query(f"""WITH {EDGES_SQL}, mid AS (SELECT region, (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS lat FROM edges GROUP BY 1),
cut AS (SELECT region, lat, (x2 - x1) * (lat - y1) / (y2 - y1) + x1 AS x FROM edges JOIN mid USING (region) WHERE (y1 > lat) <> (y2 > lat)),
o AS (SELECT *, row_number() OVER w AS k, lead(x) OVER w AS high FROM cut WINDOW w AS (PARTITION BY region ORDER BY x))
SELECT region, {jr('arg_max((x + high) / 2, (high - x, -x))', 6)} AS lon, {jr('any_value(lat)', 6)} AS lat FROM o WHERE k % 2 = 1 GROUP BY region""")
def label_points(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.label_points(spatial.edges_of(V.regions(spark, d)))
    return p.select("region", N.js_round("lon", 6).alias("lon"), N.js_round("lat", 6).alias("lat"))


# ---- archive
ARCHIVE_SQL = """rows_ AS (SELECT CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE 'R' || (l_suppkey % 7) END AS region, year(l_shipdate) AS year, (l_linenumber + l_orderkey) % 5 AS type, l_extendedprice - 20000 AS frp FROM lineitem)"""
YEARS = list(range(1994, 2000))


def _archive(spark: SparkSession, d: str) -> DataFrame:
    region = F.when(F.col("l_suppkey") % 10 != 9, F.concat(F.lit("R"), (F.col("l_suppkey") % 7).cast("string")))
    return table(spark, d, "lineitem").select(region.alias("region"), F.year("l_shipdate").alias("year"), ((F.col("l_linenumber") + F.col("l_orderkey")) % 5).alias("type"), (F.col("l_extendedprice") - 20000).alias("frp"))


def _archive_regions(spark: SparkSession) -> DataFrame:
    return spark.range(9).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("region"), (F.lit(50000.0) + F.col("id") * 10000).alias("area_km2"))


COUNTS_SQL = f"""counts AS (SELECT g.region, y.year, count(r.type) FILTER (r.type = 0) AS vegetation, count(r.type) FILTER (r.type = 2) AS static, count(r.type) FILTER (r.type = 3) AS offshore,
  {jr(jr('coalesce(sum(greatest(r.frp, 0)) FILTER (r.type = 0), 0)', 6), 1)} AS frp_vegetation FROM (SELECT 'R' || i AS region FROM range(9) t(i)) g, (SELECT unnest({YEARS})::BIGINT AS year) y LEFT JOIN rows_ r ON r.region = g.region AND r.year = y.year GROUP BY ALL)"""


@query(f"WITH {ARCHIVE_SQL}, {COUNTS_SQL} SELECT region, year::INT AS year, vegetation, static, offshore, frp_vegetation FROM counts")
def archive_region_year_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.archive_counts(_archive(spark, d), _archive_regions(spark), YEARS)


@query(f"WITH {ARCHIVE_SQL} SELECT count(*) FILTER (region IS NULL) AS outside_regions, count(*) FILTER (year NOT IN {tuple(YEARS)}) AS outside_years, count(*) FILTER (type = 1) AS volcano, count(*) FILTER (type > 3) AS other FROM rows_")
def archive_side_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.archive_side_counts(_archive(spark, d), YEARS)


@query(f"""WITH {H_SQL}, x AS (SELECT floor(lat / 0.004::DOUBLE)::BIGINT AS r, lon FROM h WHERE id % 4 = 2)
SELECT DISTINCT r AS "row", floor(lon * cos((r + 0.5::DOUBLE) * 0.004::DOUBLE * pi() / 180) / 0.004::DOUBLE)::BIGINT AS "col" FROM x""")
def archive_static_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = V.hotspots(spark, d).select("lat", "lon", (F.col("id") % 4).alias("type"), F.year("acquired_at").alias("year"))
    return R.archive_static_cells(rows, 2022)


@query(f"""WITH {ARCHIVE_SQL}, {COUNTS_SQL}, s AS (SELECT region, year, CASE WHEN region = 'R6' AND year = 1995 THEN NULL ELSE vegetation END AS value FROM counts),
b AS (SELECT *, count(value) OVER w AS n, sum(value) OVER w / 5 AS mean FROM s WINDOW w AS (PARTITION BY region ORDER BY year RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT region, year::INT AS year, value, CASE WHEN n = 5 AND value IS NOT NULL THEN mean END AS baseline, CASE WHEN n = 5 AND mean <> 0 THEN {jr('(value - mean) / mean * 100', 1)} END AS deviation_pct,
  CASE WHEN value IS NULL THEN 'no value' WHEN n < 5 THEN 'years missing' WHEN mean = 0 THEN 'mean is zero' END AS reason FROM b""")
def deviation_5y(spark: SparkSession, d: str) -> DataFrame:
    c = R.archive_counts(_archive(spark, d), _archive_regions(spark), YEARS)
    return R.deviation(c.select("region", "year", F.when((F.col("region") != "R6") | (F.col("year") != 1995), F.col("vegetation")).alias("value")))


@query(f"WITH {ARCHIVE_SQL}, {COUNTS_SQL} SELECT region, year::INT AS year, vegetation, {jr('vegetation / (50000::DOUBLE + right(region, 1)::INT * 10000) * 10000', 2)} AS per_10k FROM counts")
def density_per_area(spark: SparkSession, d: str) -> DataFrame:
    g = _archive_regions(spark)
    return R.density_series(R.archive_counts(_archive(spark, d), g, YEARS), g)


POINTS_SQL = """spots AS (SELECT 50.2::DOUBLE + (l_partkey * 7919 + l_linenumber * 131) % 9973 * 0.0008::DOUBLE AS lat, 95.5::DOUBLE + (l_suppkey * 104729 + l_orderkey * 31) % 16007 * 0.001::DOUBLE AS lon,
  year(l_shipdate) AS year, (l_linenumber + l_orderkey) % 5 AS type, l_extendedprice - 20000 AS frp FROM lineitem WHERE l_orderkey % 101 > 0 AND l_orderkey % 103 > 0),
places AS (SELECT row_number() OVER () AS id, lat, lon FROM (SELECT DISTINCT lat, lon FROM spots))"""


def _archive_points(spark: SparkSession, d: str) -> DataFrame:
    """A yearly archive as text, some rows without a place on earth."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    lat = F.lit(50.2) + (F.col("l_partkey") * 7919 + n * 131) % 9973 * 0.0008
    lon = F.lit(95.5) + (F.col("l_suppkey") * 104729 + k * 31) % 16007 * 0.001
    return table(spark, d, "lineitem").select(
        F.when(k % 101 == 0, "95").otherwise(lat.cast("string")).alias("latitude"), F.when(k % 103 == 0, "").otherwise(lon.cast("string")).alias("longitude"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("acq_date"),
        ((n + k) % 5).cast("string").alias("type"), (F.col("l_extendedprice") - 20000).cast("string").alias("frp"),
    )


@query(f"""WITH {POINTS_SQL}, {EDGES_SQL}, {pip_sql('places')},
r AS (SELECT f.region, s.year, s.type, s.frp FROM spots s JOIN places p ON p.lat = s.lat AND p.lon = s.lon JOIN first_region f USING (id))
SELECT g.r_name AS region, y.year::INT AS year, count(r.type) FILTER (r.type = 0) AS vegetation, count(r.type) FILTER (r.type = 2) AS static, count(r.type) FILTER (r.type = 3) AS offshore,
  {jr(jr('coalesce(sum(greatest(r.frp, 0)) FILTER (r.type = 0), 0)', 6), 1)} AS frp_vegetation FROM region g, (SELECT unnest({YEARS})::BIGINT AS year) y LEFT JOIN r ON r.region = g.r_name AND r.year = y.year GROUP BY 1, 2""")
def archive_from_points(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a yearly archive from its coordinates: read, checked, placed in regions, counted."""
    regions = V.regions(spark, d)
    return R.archive_from_points(readers.archive_rows(_archive_points(spark, d)), spatial.edges_of(regions), regions, YEARS)


@query("""WITH c AS (SELECT user_id % 80 AS region, 2000 + day(ts) AS year, count(*) FILTER (day(ts) % 5 > 0) AS n FROM events GROUP BY ALL)
SELECT count(DISTINCT region) || ' regions' AS problem FROM c HAVING count(DISTINCT region) <> 83 UNION ALL SELECT 'year ' || year || ' is empty' FROM c GROUP BY year HAVING sum(n) = 0""")
def archive_gate(spark: SparkSession, d: str) -> DataFrame:
    """Counts by region and year with too few regions, and years without any detection."""
    e, day = table(spark, d, "events"), F.dayofmonth("ts")
    counts = e.groupBy((F.col("user_id") % 80).cast("string").alias("region"), (day + 2000).alias("year")).agg(F.count_if(day % 5 > 0).alias("vegetation"))
    return R.archive_problems(counts, 83)


# ---- official statistics
PATTERNS = [(r"^(total|sum)(\s|$)", "total"), (r"district$", "district")]


@query("""WITH n AS (SELECT o_orderkey AS ord, CASE o_orderkey % 6 WHEN 0 THEN ' Nation_' || (o_custkey % 30) || ' (old)' WHEN 1 THEN 'NATION_' || (o_custkey % 30) || ' .' WHEN 2 THEN 'Total ' || o_custkey WHEN 3 THEN 'г. nation_' || (o_custkey % 30)
  WHEN 4 THEN 'nation_3' ELSE 'North  district' END AS name, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS value, year(o_orderdate)::INT AS year FROM orders),
k AS (SELECT *, CASE ord % 6 WHEN 4 THEN 'nation_3' WHEN 2 THEN NULL WHEN 5 THEN NULL ELSE regexp_extract(lower(name), 'nation_[0-9]+') END AS plain FROM n),
j AS (SELECT k.*, n_name FROM k JOIN nation ON lower(n_name) = plain WHERE plain <> 'nation_7')
SELECT n_name AS iso, arg_max(value, (value IS NOT NULL, year, -ord)) FILTER (value IS NOT NULL) AS value, arg_max(year, (value IS NOT NULL, year, -ord)) AS year FROM j GROUP BY 1""")
def regional_extract_newest(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 30).cast("string")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit(" Nation_"), c, F.lit(" (old)"))).when(k % 6 == 1, F.concat(F.lit("NATION_"), c, F.lit(" .")))
        .when(k % 6 == 2, F.concat(F.lit("Total "), F.col("o_custkey").cast("string"))).when(k % 6 == 3, F.concat(F.lit("г. nation_"), c)).when(k % 6 == 4, "nation_3").otherwise("North  district")
    )
    rows = table(spark, d, "orders").select(k.alias("ord"), name.alias("name"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("value"), F.year("o_orderdate").alias("year"))
    aliases = table(spark, d, "nation").select(T.normalize_region_name("n_name").alias("alias"), F.col("n_name").alias("iso"))
    excluded = spark.createDataFrame([("nation_7", "not covered")], "alias string, reason string")
    return R.newest_values(R.classify_names(rows, aliases, excluded, PATTERNS).where("kind = 'region'"))


@query(f"""WITH e AS (SELECT n_regionkey AS k, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
f AS (SELECT n_regionkey AS k, sum(s_acctbal) AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1)
SELECT r_name AS region, 'customers' AS indicator, CASE WHEN k % 4 <> 3 THEN n END::DOUBLE AS value, CASE WHEN k % 4 = 3 THEN 'no value in source' END AS reason FROM region JOIN e ON k = r_regionkey
UNION ALL SELECT r_name, 'balance', {jr('v', 2)}, CASE WHEN k IS NULL THEN 'region not in source' END FROM region LEFT JOIN f ON k = r_regionkey""")
def indicator_long_format(spark: SparkSession, d: str) -> DataFrame:
    r = V.regions(spark, d)
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = nation.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "r_regionkey").agg(F.count(F.lit(1)).alias("n"))
    people = people.select(F.col("r_name").alias("region"), F.when(F.col("r_regionkey") % 4 != 3, F.col("n")).alias("value"), F.lit("2024").alias("period"))
    money = nation.where("n_regionkey <> 2").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(N.js_round(F.sum("s_acctbal"), 2).alias("value"))
    money = money.select(F.col("r_name").alias("region"), "value", F.lit("2024").alias("period"))
    out = R.indicators(r, {"customers": (people, "persons", "official"), "balance": (money, "units", "estimate")})
    return out.select("region", "indicator", "value", "reason")


@query("SELECT row_number() OVER (ORDER BY coalesce(nullif(list_position(['NATION_7', 'NATION_3', 'NATION_11'], n_name), 0), 4), n_regionkey DESC NULLS LAST, n_name)::INT AS place, n_name AS name FROM nation")
def regions_pinned_sort(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("value"))
    order = R.region_order("value", descending=True, iso="name", pinned=("NATION_7", "NATION_3", "NATION_11"))
    return running_sums(n, order, {"before": F.lit(1)}, "pinned").select((F.col("before") + 1).cast("int").alias("place"), "name")


@query("""WITH r AS (SELECT n_nationkey AS ord, CASE n_nationkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'Всего по ' || n_name WHEN 2 THEN 'Российская Федерация' ELSE n_name END AS name, CASE n_nationkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN n_nationkey || '.5 thousand' ELSE n_nationkey::VARCHAR END AS raw FROM nation),
v AS (SELECT *, CASE ord % 5 WHEN 0 THEN 0 WHEN 1 THEN ord + 0.5 ELSE ord END::DOUBLE AS value FROM r WHERE name <> '')
SELECT arg_min(value, ord) FILTER (lower(name) LIKE '%российская федерация%' OR lower(name) LIKE '%всего по%') AS wood_volume, arg_min(value, ord) FILTER (lower(name) LIKE '%российская федерация%' OR lower(name) LIKE '%всего%') AS forestland,
  (SELECT max(1990 + n_nationkey) FROM nation WHERE 1990 + n_nationkey > 2000)::INT AS reforested_year, (SELECT arg_max(CASE n_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN n_nationkey + 0.5 ELSE n_nationkey END::DOUBLE, n_nationkey) FROM nation) AS reforested_area,
  (SELECT arg_min(CASE ord % 5 WHEN 0 THEN 0 WHEN 1 THEN ord + 0.5 ELSE ord END::DOUBLE, ord) FROM r) AS fires_area, (SELECT count(*) FROM v WHERE lower(name) NOT LIKE '%российская федерация%' AND lower(name) NOT LIKE '%всего%') AS regions FROM v""")
def official_summary(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    label = F.when(k % 8 == 0, "").when(k % 8 == 1, F.concat(F.lit("Всего по "), name)).when(k % 8 == 2, "Российская Федерация").otherwise(name)
    raw = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".5 thousand"))).otherwise(k.cast("string"))
    n = table(spark, d, "nation")
    rows = n.select(k.alias("ord"), label.alias("region"), label.alias("subjects"), raw.alias("volume"), raw.alias("area"), (k + 1990).cast("string").alias("year"))
    wood = official.typed(rows, "wood_volume")
    out = official.summary(wood, official.typed(rows, "forestland"), official.typed(rows, "reforestation"), official.typed(rows, "fires_area"))
    return out.crossJoin(official.without_totals(wood).agg(F.count(F.lit(1)).alias("regions")))  # one row each


@query("""WITH t AS (SELECT n_name AS region, ['official', 'estimate', 'satellite', 'other'][(n_nationkey % 4 + 1)::INT] AS kind, CASE n_nationkey % 5 WHEN 0 THEN 'NASA FIRMS' WHEN 1 THEN 'Hansen / GFW' WHEN 2 THEN 'GFWX' WHEN 3 THEN 'данные Рослесхоза' END AS source FROM nation)
SELECT region, list_position(['official', 'satellite', 'estimate'], kind)::INT AS place, array_to_string(list_concat(CASE WHEN source LIKE '%Рослесхоз%' THEN ['rosleshoz'] ELSE [] END, CASE WHEN source LIKE '%FIRMS%' THEN ['firms'] ELSE [] END, CASE WHEN source LIKE '%Hansen%' THEN ['gfw'] ELSE [] END, ['osm']), ',') AS sources
FROM t WHERE kind <> 'other'""")
def report_groups(spark: SparkSession, d: str) -> DataFrame:
    """A region's place in a report by its kind, and the sources that it cites."""
    k = F.col("n_nationkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("official", "estimate", "satellite", "other")]), (k % 4 + 1).cast("int"))
    source = F.when(k % 5 == 0, "NASA FIRMS").when(k % 5 == 1, "Hansen / GFW").when(k % 5 == 2, "GFWX").when(k % 5 == 3, "данные Рослесхоза")
    t = table(spark, d, "nation").select(F.col("n_name").alias("region"), kinds.alias("kind"), source.alias("source"))
    cited = R.report_sources(t).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("place", "cited"))).alias("c"))
    return R.report_groups(t).join(cited, "region").select("region", "place", F.array_join(F.transform("c", lambda c: c["cited"]), ",").alias("sources"))


@query("WITH l AS (SELECT 'c' || (o_custkey % 40) AS code, year(o_orderdate) AS year, sum(o_totalprice) AS area_ha FROM orders WHERE o_orderkey % 6 > 0 OR year(o_orderdate) < 1996 GROUP BY 1, 2), r AS (SELECT code, arg_max(year, year)::INT AS year, arg_max(area_ha, year) AS area_ha FROM l GROUP BY 1) SELECT 'R' || i AS iso, year, floor(area_ha) AS area_ha FROM r JOIN range(30) t(i) ON code = 'c' || i")
def latest_loss(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where((F.col("o_orderkey") % 6 > 0) | (F.year("o_orderdate") < 1996))
    rows = o.groupBy(F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("code"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("area_ha"))
    i = F.col("id").cast("string")
    out = R.latest_loss(rows, spark.range(30).select(F.concat(F.lit("c"), i).alias("code"), F.concat(F.lit("R"), i).alias("iso")))
    return out.select("iso", "year", F.floor("area_ha").cast("double").alias("area_ha"))


# ---- loss
LOSS_VALUES = ", ".join(f"({y}, {a})" for y, a in R.NATIONAL_LOSS_HA.items())
SHARE_VALUES = ", ".join(f"('{c}', {s}::DOUBLE)" for c, s in R.LOSS_SHARE.items())
LOSS_SQL = f"""est AS (SELECT code, year, {jr('area * share')} AS area_ha, {jr(jr('area * share') + ' * 148')} AS emissions FROM (VALUES {LOSS_VALUES}) n(year, area), (VALUES {SHARE_VALUES}) s(code, share))"""


@query(f"WITH {LOSS_SQL} SELECT code, sum(area_ha) AS total, {jr('avg(area_ha)')} AS mean, arg_max(year, (area_ha, -year)) AS peak_year, sum(emissions) AS emissions FROM est GROUP BY code")
def loss_kpis(spark: SparkSession, d: str) -> DataFrame:
    shares = spark.createDataFrame(list(R.LOSS_SHARE.items()), "code string, share double")
    return R.loss_kpis(R.loss_estimates(R.national_loss(spark), shares), ["code"])


@query(f"SELECT n_name, {jr('sum(o_totalprice) / (c.n * 1000::DOUBLE) * 100000', 1)} AS per_100k, {jr('least(100, greatest(0, c.n / 300::DOUBLE * 100))', 2)} AS share FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey GROUP BY n_name, c.n")
def loss_per_100k(spark: SparkSession, d: str) -> DataFrame:
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    n = customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    spent = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("total"))
    j = spent.join(n, F.col("c_nationkey") == F.col("k")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("n_name", N.js_round(N.loss_per_100k_ha("total", "n"), 1).alias("per_100k"), N.js_round(N.share_percent("n", F.lit(300.0)), 2).alias("share"))


# ---- protected areas as a map's relations: rectangles in four ways, open ones, lines without an area, ones with a hole, ones without ways, rectangles in one way
AREA_NAMES = ["Заповедник", "Reserve", "ნაკრძალი", "Մարզ"]
AREA_TAGS = ["12.5 ha", "-3", "x", "1e2"]
RELATIONS_SQL = f"""r0 AS (SELECT c_custkey AS id, c_custkey % 6 AS form, c_nationkey AS part, 97::DOUBLE + (c_custkey % 89) * 0.14::DOUBLE AS x0, 50.2::DOUBLE + (c_custkey % 97) * 0.06::DOUBLE AS y0, 0.08::DOUBLE + (c_custkey % 5) * 0.02::DOUBLE AS w, 0.05::DOUBLE + (c_custkey % 3) * 0.02::DOUBLE AS h,
  {AREA_NAMES!r}[(c_custkey % 4 + 1)::INT] AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Парк' END AS ru, {AREA_TAGS!r}[(c_custkey // 2 % 4 + 1)::INT] AS tag FROM customer),
r AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM r0 WHERE part <> 7),
lab AS (SELECT *, CASE WHEN form = 1 THEN (x0 + x1 + x1 + x1) / 4 WHEN form = 3 THEN (x0 + (x0 + w * 0.6::DOUBLE)) / 2 ELSE (x0 + x1) / 2 END AS lon, CASE WHEN form = 1 THEN (y0 + y0 + y0 + y1) / 4 ELSE (y0 + y1) / 2 END AS lat FROM r WHERE form IN (0, 1, 3, 5))"""


def _rect_km2(x0: str, y0: str, x1: str, y1: str) -> str:
    f = lambda v: f"round({v}, 5)"
    return f"(abs({rad(f'{f(x1)} - {f(x0)}')} * (2 + 2 * sin({rad(f(y0))})) - {rad(f'{f(x1)} - {f(x0)}')} * (2 + 2 * sin({rad(f(y1))}))) * pow({N.AREA_RADIUS_KM}::DOUBLE, 2) / 2)"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Map answers (JSON), one for each nation; one reports an error."""
    k = F.col("c_custkey")
    x0, y0, w, h = F.lit(97.0) + (k % 89) * 0.14, F.lit(50.2) + (k % 97) * 0.06, F.lit(0.08) + (k % 5) * 0.02, F.lit(0.05) + (k % 3) * 0.02
    c = table(spark, d, "customer").select(k.alias("id"), "c_nationkey", x0.alias("x0"), y0.alias("y0"), w.alias("w"), (x0 + w).alias("x1"), (y0 + h).alias("y1"), h.alias("h"))
    at = lambda x, y: F.struct((F.col(y) if isinstance(y, str) else y).alias("lat"), (F.col(x) if isinstance(x, str) else x).alias("lon"))
    way = lambda *points, role="outer": F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), F.array(*points).alias("geometry"))
    a, b, e, f = at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")
    inner = [at(F.col("x0") + F.col("w") * p, F.col("y0") + F.col("h") * q) for p, q in ((0.6, 0.3), (0.8, 0.3), (0.8, 0.7), (0.6, 0.7), (0.6, 0.3))]
    up = at("x0", F.col("y0") + F.col("h") * 0.5)
    forms = [F.array(way(a, b), way(f, e), way(f, a), way(b, e)), F.array(way(a, b), way(b, e)), F.array(way(a, up, f), way(f, a)), F.array(way(a, b, e), way(*inner, role="inner"), way(e, f, a))]
    kind, k = F.col("id") % 6, F.col("id")
    members = F.when(kind == 0, forms[0]).when(kind == 1, forms[1]).when(kind == 2, forms[2]).when(kind == 3, forms[3]).when(kind == 5, F.array(way(a, b, e, f, a)))
    members = F.coalesce(members, F.array().cast("array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>"))
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    tags = F.map_filter(F.create_map(F.lit("name"), pick(AREA_NAMES, k % 4), F.lit("name:ru"), F.when(k % 3 == 0, "Парк"), F.lit("area:ha"), pick(AREA_TAGS, F.floor(k / 2) % 4)), lambda _, v: v.isNotNull())
    each = c.select("c_nationkey", F.struct(F.lit("relation").alias("type"), "id", tags.alias("tags"), members.alias("members")).alias("e"))
    part = each.groupBy("c_nationkey").agg(F.collect_list("e").alias("elements"))
    return part.select(F.to_json(F.struct("elements", F.when(F.col("c_nationkey") == 7, "runtime error: timed out").alias("remark"))).alias("value"))


@query(f"""WITH {RELATIONS_SQL}, {EDGES_SQL}, {pip_sql('lab')}
SELECT id, CASE WHEN form = 1 THEN 'point' ELSE 'polygon' END AS kind, coalesce(ru, name) AS name, {jr('lat', 6)} AS lat, {jr('lon', 6)} AS lon,
  CASE tag WHEN '12.5 ha' THEN 12.5 WHEN '1e2' THEN 100 ELSE CASE WHEN form <> 1 THEN {jr('(' + _rect_km2('x0', 'y0', 'x1', 'y1') + ' - CASE WHEN form = 3 THEN ' + _rect_km2('x0 + w * 0.6::DOUBLE', 'y0 + h * 0.3::DOUBLE', 'x0 + w * 0.8::DOUBLE', 'y0 + h * 0.7::DOUBLE') + ' ELSE 0 END) * 100', 1)} END END::DOUBLE AS area_ha
FROM lab WHERE id IN (SELECT id FROM inside) AND NOT regexp_matches(name, '[Ⴀ-ჿ]|[԰-֏]')""")
def protected_features(spark: SparkSession, d: str) -> DataFrame:
    """From map answers to features: gates, rings from ways, label points, territory and regions."""
    found, _, _ = protected.features(protected.relations(_answers(spark, d)), spatial.edges_of(V.regions(spark, d)))
    return found.select("id", "kind", "name", N.js_round("lat", 6).alias("lat"), N.js_round("lon", 6).alias("lon"), "area_ha")


@query(f"WITH {RELATIONS_SQL} SELECT id, 'zero area' AS problem FROM r WHERE form = 2")
def protected_problems(spark: SparkSession, d: str) -> DataFrame:
    """Relations whose shape doesn't pass the gate."""
    _, _, bad = protected.features(protected.relations(_answers(spark, d)), spatial.edges_of(V.regions(spark, d)))
    return bad.select("id", "problem")

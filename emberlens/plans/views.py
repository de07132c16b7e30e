"""Views that stand in for the engine's own tables, derived by rule from the generated ones, each in Spark and in SQL.

Every query is registered with ``query``, which keeps its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlens.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- SQL text shared by the oracles
def jr(x: str, digits: int = 0) -> str:
    return f"(floor(({x}) * {10**digits}::DOUBLE + 0.5) / {10**digits}::DOUBLE)"


def rad(x: str) -> str:
    return f"(({x}) * pi() / 180)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6371.0088) -> str:
    a = f"pow(sin({rad(f'({lat2}) - ({lat1})')} / 2), 2) + cos({rad(lat1)}) * cos({rad(lat2)}) * pow(sin({rad(f'({lon2}) - ({lon1})')} / 2), 2)"
    return f"(asin(least(1::DOUBLE, sqrt({a}))) * {2 * radius}::DOUBLE)"


H_SQL = """h AS (
  SELECT event_id AS id, ts AS acquired_at, value AS frp, event_type,
    51::DOUBLE + (user_id % 10) * 0.6::DOUBLE + ((event_id * 7919) % 101 - 50) * 0.0008::DOUBLE AS lat,
    98::DOUBLE + (user_id % 7) * 1.8::DOUBLE + ((event_id * 104729) % 103 - 51) * 0.0012::DOUBLE AS lon,
    ['N', 'N20', 'N21'][(event_id % 3 + 1)::INT] AS satellite,
    CASE WHEN event_id % 9 = 0 THEN 'high' WHEN event_id % 9 < 7 THEN 'nominal' ELSE 'low' END AS confidence FROM events),
w AS (SELECT * FROM h WHERE acquired_at >= (SELECT max(acquired_at) FROM h) - INTERVAL 72 HOUR)"""


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    """events as detections: id, acquired_at, frp, lat, lon, satellite, confidence around 70 sites."""
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("id"), F.col("ts").cast("timestamp").alias("acquired_at"), F.col("value").alias("frp"), "event_type",
        (F.lit(51.0) + (u % 10) * 0.6 + ((i * 7919) % 101 - 50) * 0.0008).alias("lat"), (F.lit(98.0) + (u % 7) * 1.8 + ((i * 104729) % 103 - 51) * 0.0012).alias("lon"),
        F.element_at(F.array(F.lit("N"), F.lit("N20"), F.lit("N21")), (i % 3 + 1).cast("int")).alias("satellite"),
        F.when(i % 9 == 0, "high").when(i % 9 < 7, "nominal").otherwise("low").alias("confidence"),
    )


def newest(h: DataFrame):
    """The newest acquisition as a literal: the ``as_of`` of a run over a fixed table."""
    return F.lit(h.agg(F.max("acquired_at")).first()[0])


def recent(spark: SparkSession, d: str) -> DataFrame:
    """Detections of the last 72 hours before the newest one."""
    h = hotspots(spark, d)
    return h.where(F.col("acquired_at") >= newest(h) - F.expr("INTERVAL '72' HOUR"))


# Vertices of each region: ring, position, longitude, latitude above 50.4 + 1.2 * r_regionkey. Regions overlap by 0.3 degrees and have a hole.
SHAPE = [(0, 1, 97.0, 0.0), (0, 2, 110.5, 0.1), (0, 3, 109.5, 1.5), (0, 4, 98.0, 1.4), (0, 5, 97.0, 0.0), (1, 1, 101.0, 0.5), (1, 2, 103.0, 0.5), (1, 3, 102.0, 1.0), (1, 4, 101.0, 0.5)]
EDGES_SQL = f"""pts AS (
  SELECT r_regionkey AS ord, r_name AS region, ring, p, x::DOUBLE AS x, 50.4::DOUBLE + 1.2::DOUBLE * r_regionkey + dy::DOUBLE AS y
  FROM region, (VALUES {', '.join(map(str, SHAPE))}) v(ring, p, x, dy)),
edges AS (SELECT a.ord, a.region, a.ring, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pts a JOIN pts b ON a.ord = b.ord AND a.ring = b.ring AND b.p = a.p + 1)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    """region as polygons with a hole: region, ord, name, area_km2, polygons."""
    low = F.lit(50.4) + F.lit(1.2) * F.col("r_regionkey")
    rings = F.array(*[F.array(*[F.struct(F.lit(x).alias("lon"), (low + dy).alias("lat")) for ring, _, x, dy in SHAPE if ring == k]) for k in (0, 1)])
    return table(spark, d, "region").select(F.col("r_name").alias("region"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), (F.lit(100000.0) + F.col("r_regionkey") * 25000.0).alias("area_km2"), F.array(rings).alias("polygons"))


def pip_sql(points: str) -> str:
    """CTE inside(id, ord, region): each point's regions by the even-odd rule. ``points`` is a relation with id, lat, lon."""
    return f"""crossed AS (
  SELECT p.id, e.ord, e.region, e.ring, count(*) % 2 AS odd FROM {points} p JOIN edges e
  ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL),
inside AS (SELECT id, ord, region FROM crossed WHERE odd = 1 GROUP BY ALL HAVING bool_or(ring = 0) AND NOT bool_or(ring = 1)),
first_region AS (SELECT id, arg_min(region, ord) AS region FROM inside GROUP BY id)"""


INCIDENTS_SQL = """i AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS forest_area_id, lower(o_orderpriority) AS change_type, o_orderstatus AS severity,
    o_orderdate::DATE AS detected_date, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS area_ha, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 101) / 100::DOUBLE END AS confidence,
    CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'firms' END AS source, ['active', 'inactive', 'static_source', NULL][(o_orderkey % 4 + 1)::INT] AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'own ' || (o_orderkey % 5) END AS own_region FROM orders),
a AS (SELECT c_custkey AS area_id, c_name AS forest_area_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS area_region FROM customer),
f AS (SELECT i.*, a.forest_area_name, coalesce(a.area_region, i.own_region) AS region FROM i LEFT JOIN a ON a.area_id = i.forest_area_id)"""


def incidents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    states = F.array(F.lit("active"), F.lit("inactive"), F.lit("static_source"), F.lit(None).cast("string"))
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 != 0, F.col("o_custkey")).alias("forest_area_id"), F.lower("o_orderpriority").alias("change_type"), F.col("o_orderstatus").alias("severity"),
        F.col("o_orderdate").cast("date").alias("detected_date"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("area_ha"), F.when(k % 11 != 0, (k % 101) / 100.0).alias("confidence"),
        F.when(k % 4 == 0, "manual").otherwise("firms").alias("source"), F.element_at(states, (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 5 != 0, F.concat(F.lit("own "), (k % 5).cast("string"))).alias("own_region"),
    )


def areas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("region"))


RUNS_SQL = "runs AS (SELECT event_id AS run_id, 's' || (user_id % 8) AS source, ts AS seen, event_id % 4 <> 0 AS ok FROM events)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """events as a run journal."""
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("source"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 4 != 0).alias("ok"))


PIXELS_SQL = """px AS (
  SELECT l_orderkey % 40 AS scene, l_partkey AS id, (l_suppkey * 7 + l_linenumber) % 12 AS scl, 200 + l_quantity * 37 AS b4, 500 + l_quantity * 11 + l_linenumber * 90 AS b8,
    CASE WHEN l_linenumber = 7 THEN 0 ELSE 100 + l_linenumber * 130 END AS b12, l_quantity * 9 AS b2, l_quantity * 13 AS b3, l_linenumber * 77 AS b11, l_orderkey, l_linenumber FROM lineitem)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as pixels: scene, scl and digital numbers of bands."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("scene"), F.col("l_partkey").alias("id"), ((F.col("l_suppkey") * 7 + n) % 12).alias("scl"), (q * 37 + 200).alias("b4"), (q * 11 + 500 + n * 90).alias("b8"),
        F.when(n == 7, 0).otherwise(n * 130 + 100).cast("double").alias("b12"), (q * 9).alias("b2"), (q * 13).alias("b3"), (n * 77).cast("double").alias("b11"), "l_orderkey", "l_linenumber",
    )

"""Queries on pixels and scenes, on the run journal and the gates, and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlens.functions import numeric as N, spectral as S, text as T
from emberlens.operators import last_good, raster, status
from emberlens.plans import views as V
from emberlens.plans.views import PIXELS_SQL, RUNS_SQL, jr, query
from emberlens.session import table
from emberlens.shared import materialize, scratch_path
from emberlens.streaming import ingest


# ---- spectral indices
def _case(value: str, index: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {bound}::DOUBLE THEN '{name}'" for bound, name in S.CLASSES[index][:-1]) + f" ELSE '{S.CLASSES[index][-1][1]}' END"


def _index_sql(name: str, value: str, ok: str) -> str:
    return f"CASE WHEN {ok} THEN {jr(value, 4)} ELSE 0 END AS {name}, CASE WHEN {ok} THEN {_case(value, name)} ELSE 'no_data' END AS {name}_class"


RATIOS = {"ndvi": ("(b8 - b4) / (b8 + b4)", "b8 + b4 <> 0"), "nbr": ("(b8 - b12) / (b8 + b12)", "b12 <> 0 AND b8 + b12 <> 0"), "ndwi": ("(b3 - b8) / (b3 + b8)", "b3 <> 0 AND b3 + b8 <> 0"),
          "ndmi": ("(b8 - b11) / (b8 + b11)", "b11 <> 0 AND b8 + b11 <> 0"), "savi": ("(b8 - b4) / (b8 + b4 + 0.5::DOUBLE) * 1.5", "b8 + b4 + 0.5 <> 0"),
          "evi": ("greatest(-1, least(1, (b8 - b4) / (b8 + b4 * 6 - b2 * 7.5::DOUBLE + 1) * 2.5))", "b2 <> 0 AND b8 + b4 * 6 - b2 * 7.5::DOUBLE + 1 <> 0")}


@query(f"WITH {PIXELS_SQL} SELECT l_orderkey, l_linenumber, {', '.join(_index_sql(k, *v) for k, v in RATIOS.items())} FROM px")
def spectral_indices(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d)
    made = {"ndvi": S.ndvi("b8", "b4"), "nbr": S.nbr("b8", "b12"), "ndwi": S.ndwi("b3", "b8"), "ndmi": S.ndmi("b8", "b11"), "savi": S.savi("b8", "b4"), "evi": S.evi("b2", "b4", "b8")}
    return p.select("l_orderkey", "l_linenumber", *[c for k, v in made.items() for c in (v["value"].alias(k), v["classification"].alias(f"{k}_class"))])


@query(f"WITH {PIXELS_SQL}, v AS (SELECT l_orderkey, l_linenumber, b8 / 1000 - b4 / 3000 AS x FROM px) SELECT l_orderkey, l_linenumber, {jr('x', 4)} AS dnbr, {_case('x', 'dnbr')} AS class, {_case('x', 'severity')} AS severity FROM v")
def dnbr_severity(spark: SparkSession, d: str) -> DataFrame:
    x = S.dnbr(F.col("b8") / 1000, F.col("b4") / 3000)
    return V.pixels(spark, d).select("l_orderkey", "l_linenumber", x["value"].alias("dnbr"), x["classification"].alias("class"), S.severity(F.col("b8") / 1000 - F.col("b4") / 3000).alias("severity"))


SCL_SQL = """scl AS (SELECT scene, count(*) AS total, count(*) FILTER (scl NOT IN (0, 1, 3, 8, 9, 10, 11)) AS clear, count(*) FILTER (scl = 0) AS nodata, count(*) FILTER (scl IN (8, 9, 10)) AS cloud, count(*) FILTER (scl = 3) AS shadow,
  count(*) FILTER (scl = 11) AS snow, count(*) FILTER (scl = 1) AS saturated FROM (SELECT scene, CASE WHEN scene % 3 = 0 AND scl IN (0, 1, 3, 8, 9, 10, 11) THEN 4 ELSE scl END AS scl FROM px) GROUP BY scene)"""
USABLE = "clear / total >= 0.8 AND nodata / total <= 0.05"


def _scl(spark: SparkSession, d: str) -> DataFrame:
    """Every third scene is all clear."""
    clear = F.when((F.col("scene") % 3 == 0) & ~S.is_clear("scl"), 4).otherwise(F.col("scl"))
    return raster.scl_stats(V.pixels(spark, d).withColumn("scl", clear), ["scene"])


@query(f"WITH {PIXELS_SQL}, {SCL_SQL} SELECT *, {USABLE} AS usable FROM scl")
def scl_stats(spark: SparkSession, d: str) -> DataFrame:
    return _scl(spark, d)


# ---- scenes
SCENES_SQL = """sc AS (SELECT o_custkey % 60 AS place, o_orderkey % 40 AS scene, o_orderkey AS scene_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 31) % 100 END AS cloud,
  o_orderdate + to_seconds(o_orderkey % 3 * 40) AS seen, 100::DOUBLE + (o_orderkey % 50) * 0.1::DOUBLE AS w, 50::DOUBLE + (o_custkey % 20) * 0.1::DOUBLE AS s FROM orders)"""


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    west, south = F.lit(100.0) + (k % 50) * 0.1, F.lit(50.0) + (c % 20) * 0.1
    return table(spark, d, "orders").select(
        (c % 60).alias("place"), (k % 40).alias("scene"), k.alias("scene_id"), F.when(k % 9 != 0, ((k * 31) % 100).cast("double")).alias("cloud_cover"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(k % 3 * 40).cast("decimal(18,6)"))).alias("acquired_at"), west.alias("w"), south.alias("s"), (west + 0.5).alias("e"), (south + 0.5).alias("n"),
    )


#: Classes of pixels: some scenes all clear, some under snow, some without gaps.
PICK_KINDS = "CASE WHEN scene % 12 = 0 AND scl NOT IN (4, 5) THEN 4 WHEN scene % 5 = 1 AND scl NOT IN (4, 5) THEN 11 WHEN scene % 2 = 1 AND scl = 0 THEN 8 ELSE scl END"


@query(f"""WITH {PIXELS_SQL}, {SCENES_SQL}, scl AS (SELECT scene, count(*) AS total, count(*) FILTER (scl NOT IN (0, 1, 3, 8, 9, 10, 11)) AS clear, count(*) FILTER (scl = 0) AS nodata, count(*) FILTER (scl IN (8, 9, 10)) AS cloud, count(*) FILTER (scl = 3) AS shadow,
  count(*) FILTER (scl = 11) AS snow FROM (SELECT scene, {PICK_KINDS} AS scl FROM px) GROUP BY scene),
g AS (SELECT *, CASE WHEN epoch_ms(seen) - epoch_ms(lag(seen) OVER w) <= 60000 THEN 0 ELSE 1 END AS new FROM sc WINDOW w AS (PARTITION BY place ORDER BY seen, scene_id)),
a AS (SELECT *, sum(new) OVER (PARTITION BY place ORDER BY seen, scene_id ROWS UNBOUNDED PRECEDING) AS acq FROM g),
rk AS (SELECT place, scene_id, scene, row_number() OVER (PARTITION BY place ORDER BY acq DESC, coalesce(cloud, 100), seen, scene_id) AS rank FROM a QUALIFY rank <= 6),
k AS (SELECT rk.*, scl.*, {USABLE} AS usable FROM rk LEFT JOIN scl USING (scene)),
b AS (SELECT place, min(rank) FILTER (usable) AS best FROM k GROUP BY 1),
l AS (SELECT place, max(scene_id) FILTER (rank = best) AS scene_id, count(*) AS checked,
  count(*) FILTER (nodata <= 0.05 * total AND snow >= 0.2 * total AND snow >= cloud + shadow) * 2 > count(*) FILTER (nodata <= 0.05 * total) AS snowy FROM k JOIN b USING (place) WHERE best IS NULL OR rank <= best GROUP BY place)
SELECT t.place, l.scene_id, coalesce(l.checked, 0)::BIGINT AS checked, CASE WHEN l.scene_id IS NOT NULL THEN NULL WHEN l.checked IS NULL THEN 'missing' WHEN snowy THEN 'snow' ELSE 'cloudy' END AS reason FROM range(62) t(place) LEFT JOIN l USING (place)""")
def scene_pick(spark: SparkSession, d: str) -> DataFrame:
    """The newest usable scene of each place, or why there is none."""
    scenes = _scenes(spark, d)
    ranked = raster.ordered_candidates(scenes.select("place", "scene_id", "cloud_cover", "acquired_at"), ["place"], newest_first=True)
    stats = raster.scl_stats(V.pixels(spark, d).withColumn("scl", F.expr(PICK_KINDS)), ["scene"])
    by_id = scenes.select("scene_id", "scene").join(stats, "scene").drop("scene")
    return raster.pick_scene(spark.range(62).withColumnRenamed("id", "place"), ranked, by_id, ["place"])


@query(f"WITH {SCENES_SQL} SELECT scene_id FROM sc WHERE w <= 103 AND w + 0.5 >= 102 AND s <= 51 AND s + 0.5 >= 50.5 AND seen BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-12-31' AND cloud < 60 ORDER BY cloud, seen DESC, scene_id LIMIT 200")
def scene_search(spark: SparkSession, d: str) -> DataFrame:
    start, end = (F.lit(t).cast("timestamp") for t in ("1994-01-01", "1997-12-31"))
    return raster.search_scenes(_scenes(spark, d), {"w": 102, "s": 50.5, "e": 103, "n": 51}, start, end, 60, 200, "desc", by_cloud=True).select("scene_id")


REFLECTANCE = {b: f"CASE WHEN {b} <> 0 THEN {b} * 0.0001::DOUBLE - 0.01 END" for b in ("b4", "b8", "b12")}


def _norm(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN greatest(-1, least(1, ({a} - {b}) / ({a} + {b}))) END"


@query(f"""WITH {PIXELS_SQL}, r AS (SELECT scene, {', '.join(f'{v} AS {k}' for k, v in REFLECTANCE.items())} FROM (SELECT * REPLACE (CASE WHEN scene % 9 = 0 AND l_linenumber < 5 THEN 0 ELSE b4 END AS b4) FROM px)),
n AS (SELECT scene, {_norm('b8', 'b4')} AS v, {_norm('b8', 'b12')} AS b FROM r),
s AS (SELECT scene, count(*) AS total, count(*) FILTER (v IS NOT NULL AND b IS NOT NULL) AS valid, avg(v) FILTER (b IS NOT NULL) AS mv, avg(b) FILTER (v IS NOT NULL) AS mb FROM n GROUP BY 1)
SELECT scene, total, valid, floor(valid * 100 / total)::BIGINT AS valid_pct, CASE WHEN valid * 2 >= total THEN {jr('mv', 3)} END AS ndvi, CASE WHEN valid * 2 >= total THEN {jr('mb', 3)} END AS nbr FROM s""")
def region_index_stats(spark: SparkSession, d: str) -> DataFrame:
    p = V.pixels(spark, d).withColumn("b4", F.when((F.col("scene") % 9 == 0) & (F.col("l_linenumber") < 5), 0).otherwise(F.col("b4")))
    refl = p.select("scene", *[S.reflectance(b, 0.0001, -0.01).alias(k) for k, b in (("red", "b4"), ("nir", "b8"), ("swir2", "b12"))])
    return raster.index_stats(refl, ["scene"])


@query(f"""WITH {PIXELS_SQL}, {SCL_SQL}, sc AS (SELECT o_orderkey % 40 AS scene, o_orderkey AS scene_id, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 31) % 100 END AS cloud, o_orderdate AS seen FROM orders),
rk AS (SELECT sc.*, coalesce({USABLE}, false) AS usable, row_number() OVER (PARTITION BY year ORDER BY coalesce(sc.cloud, 100), seen, scene_id) AS rank FROM sc LEFT JOIN scl USING (scene) QUALIFY rank <= 6)
SELECT year, arg_min(scene_id, rank) FILTER (usable) AS scene_id, coalesce(min(rank) FILTER (usable), count(*))::BIGINT AS checked FROM rk GROUP BY year""")
def best_scene_per_year(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    scenes = table(spark, d, "orders").select((k % 40).alias("scene"), k.alias("scene_id"), F.year("o_orderdate").alias("year"), F.when(k % 9 != 0, ((k * 31) % 100).cast("double")).alias("cloud_cover"), F.col("o_orderdate").alias("acquired_at"))
    stats = scenes.select("scene_id", "scene").join(_scl(spark, d).select("scene", "usable"), "scene")
    return raster.best_scene(scenes, stats, ["year"])


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7) % 256 AS r, (l_suppkey * 11) % 256 AS g, (l_orderkey * 13) % 256 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, (r * 255 + g)::INT AS days, floor(b / 100)::INT AS confidence, CASE WHEN b > 0 THEN b::INT END AS year_offset, CASE WHEN b > 0 THEN {jr('least(255, r * 1.4::DOUBLE)')}::INT END AS alpha FROM t""")
def tile_decode(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = (F.col("l_partkey") * 7) % 256, (F.col("l_suppkey") * 11) % 256, (F.col("l_orderkey") * 13) % 256
    dist, loss = S.decode_disturbance(r, g, b), S.decode_loss(r, b, 8)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dist["days"].alias("days"), dist["confidence"].alias("confidence"), loss["year_offset"].alias("year_offset"), loss["alpha"].alias("alpha"))


# ---- journal and gates
@query(f"WITH {RUNS_SQL} SELECT run_id, source, row_number() OVER (PARTITION BY source ORDER BY seen DESC, run_id DESC)::INT AS rank FROM runs QUALIFY rank <= 20")
def journal_last_runs(spark: SparkSession, d: str) -> DataFrame:
    return status.last_runs(V.runs(spark, d)).select("run_id", "source", "rank")


SUMMARY_SQL = f"""{RUNS_SQL}, m AS (SELECT *, max(seen) FILTER (ok) OVER (PARTITION BY source) AS good FROM runs),
s AS (SELECT source, max(seen) AS last_attempt, arg_max(ok, (seen, run_id)) AS last_ok, max(good) AS last_success, min(seen) FILTER (NOT ok AND (good IS NULL OR seen > good)) AS failing_since, count(*) AS runs, count(*) FILTER (NOT ok) AS failures, sum(CASE WHEN run_id % 4 = 1 THEN run_id % 13 ELSE 0 END)::BIGINT AS rejected FROM m GROUP BY 1)"""


@query(f"WITH {SUMMARY_SQL} SELECT source, strftime(last_attempt, '%Y-%m-%d %H:%M:%S') AS last_attempt, last_ok, strftime(last_success, '%Y-%m-%d %H:%M:%S') AS last_success, strftime(failing_since, '%Y-%m-%d %H:%M:%S') AS failing_since, runs, failures, rejected FROM s")
def failing_since(spark: SparkSession, d: str) -> DataFrame:
    rejected = F.when(F.col("run_id") % 4 == 1, F.col("run_id") % 13).otherwise(0)
    s = status.run_summary(V.runs(spark, d).withColumn("rejected", rejected))
    return s.select("source", "last_ok", "runs", "failures", "rejected", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_attempt", "last_success", "failing_since")])


@query(f"""WITH {SUMMARY_SQL}, reg AS (SELECT 's' || i AS source, 600 * (i + 1) AS fresh, 3600 * (i + 1) AS stale FROM range(9) t(i)), top AS (SELECT max(seen) AS t FROM runs),
g AS (SELECT reg.*, s.*, date_diff('second', date_trunc('second', last_success), date_trunc('second', t)) AS age, date_diff('second', date_trunc('second', failing_since), date_trunc('second', last_attempt)) AS outage FROM reg LEFT JOIN s USING (source), top),
k AS (SELECT source, age, CASE WHEN age IS NULL THEN 4 WHEN age <= fresh THEN 1 WHEN age <= stale THEN 2 ELSE 3 END AS a, CASE WHEN last_attempt IS NULL THEN 4 WHEN failing_since IS NULL THEN 1 WHEN outage <= fresh THEN 1 WHEN outage <= stale THEN 2 ELSE 3 END AS b FROM g)
SELECT source, age AS age_seconds, ['fresh', 'delayed', 'stale', 'unknown'][a] AS data_state, ['fresh', 'delayed', 'stale', 'unknown'][b] AS access_state, ['fresh', 'delayed', 'stale', 'unknown'][greatest(a, b)] AS state FROM k""")
def freshness_state(spark: SparkSession, d: str) -> DataFrame:
    runs = V.runs(spark, d)
    summary = status.run_summary(runs)
    registry = spark.range(9).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), (F.lit(600) * (F.col("id") + 1)).alias("fresh_within"), (F.lit(3600) * (F.col("id") + 1)).alias("stale_after"))
    as_of = F.lit(runs.agg(F.max("at")).first()[0])
    out = status.source_status(registry, summary, summary.select("source", F.col("last_success").alias("newest")), as_of)
    return out.select("source", "age_seconds", "data_state", "access_state", "state")


@query(f"""WITH {RUNS_SQL}, x AS (SELECT *, lag(ok) OVER w AS before, lag(seen) OVER w AS t FROM runs WINDOW w AS (PARTITION BY source ORDER BY seen, run_id))
SELECT run_id FROM x WHERE before IS NULL OR before <> ok OR date_diff('second', date_trunc('second', t), date_trunc('second', seen)) >= 600""")
def access_throttle(spark: SparkSession, d: str) -> DataFrame:
    return status.throttled(V.runs(spark, d)).where("write").select("run_id")


def _spaced_sql(keys: str, change: str) -> str:
    begins = f"pause IS NULL OR pause >= 600000{change}"
    return f"""WITH RECURSIVE {RUNS_SQL}, x AS (SELECT *, lag(ok) OVER w AS before, epoch_ms(seen) - lag(epoch_ms(seen)) OVER w AS pause FROM runs WINDOW w AS (PARTITION BY {keys} ORDER BY seen, run_id)),
c AS (SELECT run_id, hash({keys}) AS k, epoch_ms(seen) AS ms, {begins} AS begins, sum(({begins})::INT) OVER (PARTITION BY {keys} ORDER BY seen, run_id) AS chain FROM x),
t AS (SELECT run_id, k, chain, ms FROM c WHERE begins
  UNION ALL SELECT n.run_id, n.k, n.chain, n.ms FROM (SELECT c.k, c.chain, min((c.ms, c.run_id)) AS at FROM t JOIN c ON c.k = t.k AND c.chain = t.chain AND c.ms >= t.ms + 600000 GROUP BY 1, 2) m
  JOIN c n ON n.k = m.k AND n.chain = m.chain AND (n.ms, n.run_id) = m.at)
SELECT run_id FROM t"""


@query(_spaced_sql("source, ok", ""))
def access_log_writes(spark: SparkSession, d: str) -> DataFrame:
    """Once in ten minutes for each source and outcome."""
    return status.spaced(V.runs(spark, d), ["source", "ok"]).where("write").select("run_id")


@query(_spaced_sql("source", " OR before <> ok"))
def quality_log_writes(spark: SparkSession, d: str) -> DataFrame:
    """Once in ten minutes for each source, and at each change of outcome."""
    return status.spaced(V.runs(spark, d), ["source"], change="ok").where("write").select("run_id")


@query(f"""WITH {RUNS_SQL}, reg AS (SELECT 's' || i AS source, 'name ' || i AS name, CASE WHEN i % 2 = 0 THEN 's' || (i + 1) END AS history FROM range(9) t(i)),
good AS (SELECT source, max(seen) AS t FROM runs WHERE ok GROUP BY 1)
SELECT r.source, r.name, strftime(g.t, '%Y-%m-%d %H:%M:%S') AS last_load, strftime(h.t, '%Y-%m-%d %H:%M:%S') AS last_history_write, CASE WHEN r.source = 's3' THEN 'v1' END AS version FROM reg r LEFT JOIN good g ON g.source = r.source LEFT JOIN good h ON h.source = r.history""")
def source_provenance(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("string")
    registry = spark.range(9).select(F.concat(F.lit("s"), i).alias("source"), F.concat(F.lit("name "), i).alias("name"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), (F.col("id") + 1).cast("string"))).alias("history"))
    out = status.provenance(registry, V.runs(spark, d), spark.createDataFrame([("s3", "v1")], "source string, version string"))
    return out.select("source", "name", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_load", "last_history_write")], "version")


@query(f"""WITH {RUNS_SQL}, c AS (SELECT l_orderkey % (SELECT max(event_id) + 1 FROM events) AS run_id, 'check ' || l_linenumber AS check_, l_partkey % 9 AS rejected, l_suppkey % 5 > 0 AS ok, CASE WHEN l_suppkey % 10 = 5 THEN 'too many' END AS reason FROM lineitem),
f AS (SELECT run_id, sum(rejected) AS rejected, array_to_string(list_sort(list(check_ || ': ' || coalesce(reason, 'rejected')) FILTER (NOT ok)), ';') AS failures FROM c GROUP BY 1)
SELECT r.run_id, coalesce(f.rejected, 0)::BIGINT AS rejected, coalesce(f.failures, '') AS failures FROM runs r LEFT JOIN f USING (run_id)""")
def journal_quality(spark: SparkSession, d: str) -> DataFrame:
    """Runs with what their checks dropped and why they failed."""
    runs = V.runs(spark, d)
    top = runs.agg((F.max("run_id") + 1).alias("top"))
    lines = table(spark, d, "lineitem").crossJoin(top)  # one row
    k = F.col("l_suppkey")
    checks = lines.select((F.col("l_orderkey") % F.col("top")).alias("run_id"), F.concat(F.lit("check "), F.col("l_linenumber").cast("string")).alias("check"), (F.col("l_partkey") % 9).alias("rejected"), (k % 5 > 0).alias("ok"), F.when(k % 10 == 5, "too many").alias("reason"))
    return status.folded(runs, checks).select("run_id", "rejected", F.array_join("failures", ";").alias("failures"))


@query("SELECT strftime(greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS newest")
def newest_record(spark: SparkSession, d: str) -> DataFrame:
    tables = [table(spark, d, t).select(F.col(c).cast("timestamp").alias("created_at")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return status.newest_record(*tables).select(F.date_format("newest", "yyyy-MM-dd").alias("newest"))


RAW_SQL = """raw AS (SELECT event_id, 'f' || (user_id % 20) AS file, CASE WHEN event_id % 31 = 0 THEN 'x' WHEN event_id % 37 = 0 THEN '95' ELSE '52.5' END AS latitude, CASE WHEN event_id % 41 = 0 THEN '' ELSE '104' END AS longitude,
  CASE WHEN event_id % 43 = 0 THEN '2024/01/01' ELSE '2024-01-01' END AS acq_date, CASE WHEN event_id % 47 = 0 THEN ' ' WHEN user_id % 20 = 3 AND event_id % 5 = 0 THEN NULL ELSE '0512' END AS acq_time FROM events),
checked AS (SELECT *, CASE WHEN try_cast(latitude AS DOUBLE) IS NULL OR abs(try_cast(latitude AS DOUBLE)) > 90 THEN 'latitude' WHEN try_cast(longitude AS DOUBLE) IS NULL OR abs(try_cast(longitude AS DOUBLE)) > 180 THEN 'longitude'
  WHEN NOT regexp_matches(acq_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date' WHEN coalesce(trim(acq_time), '') = '' THEN 'time' END AS problem FROM raw)"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    raw = e.select(
        k, F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("file"), F.when(k % 31 == 0, "x").when(k % 37 == 0, "95").otherwise("52.5").alias("latitude"), F.when(k % 41 == 0, "").otherwise("104").alias("longitude"),
        F.when(k % 43 == 0, "2024/01/01").otherwise("2024-01-01").alias("acq_date"), F.when(k % 47 == 0, " ").when((F.col("user_id") % 20 == 3) & (k % 5 == 0), F.lit(None)).otherwise("0512").alias("acq_time"),
    )
    return raw.withColumn("problem", status.problems_of(status.hotspot_rules()))


@query(f"WITH {RAW_SQL} SELECT file, count(*) AS total, count(problem) AS rejected, NOT (count(*) >= 20 AND count(problem) > count(*) * 0.12::DOUBLE) AS passed FROM checked GROUP BY file")
def csv_gate(spark: SparkSession, d: str) -> DataFrame:
    return status.verdict(_raw(spark, d), ["file"], 0.12)


@query(f"WITH {RAW_SQL} SELECT problem, count(*) AS n FROM checked WHERE problem IS NOT NULL GROUP BY 1")
def reason_tally(spark: SparkSession, d: str) -> DataFrame:
    return status.tally(_raw(spark, d))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1 234,5' WHEN 1 THEN '-' WHEN 2 THEN 'н/д' WHEN 3 THEN '1e3' ELSE 'abc' END AS raw, CASE o_orderkey % 5 WHEN 0 THEN 1234.5 WHEN 3 THEN 1000 END::DOUBLE AS value FROM orders)
SELECT o_orderkey, value, CASE WHEN raw NOT IN ('-', 'н/д') AND (value IS NULL OR value < 0 OR value > 1100) THEN 'raw out of range' END AS problem FROM t""")
def numeric_gate(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 5
    t = table(spark, d, "orders").select("o_orderkey", F.when(m == 0, "1 234,5").when(m == 1, "-").when(m == 2, "н/д").when(m == 3, "1e3").otherwise("abc").alias("raw"))
    return t.select("o_orderkey", T.statistics_number("raw").alias("value"), status.problems_of([status.range_rule("raw", 0, 1100)]).alias("problem"))


# ---- calendars and streams
@query("""WITH y AS (SELECT CASE WHEN year(o_orderdate) IN (1994, 1996) THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS year, count(*) AS n FROM orders GROUP BY 1)
SELECT s.year::INT AS year, y.n FROM (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1)) AS year) s LEFT JOIN y USING (year)""")
def year_gap_spine(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate") + F.year("o_orderdate").isin(1994, 1996).cast("int")  # two years have no rows of their own
    y = table(spark, d, "orders").groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"))
    spine = y.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return spine.join(y, "year", "left")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 48 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts) + INTERVAL 48 HOUR, '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n FROM s GROUP BY user_id, k""")
def session_48h(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("acquired_at"))
    s = ingest.sessions(e, ["user_id"])
    return s.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "ends")], "n")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Detections landed in files, by time, the second half's file holding some of the first again."""
    h = V.hotspots(spark, d).select("id", "acquired_at", "frp", (F.col("id") % 50).alias("site"))
    landed = materialize(h.union(h.where("id % 3 = 0")).repartition(4, F.col("id") % 4), "arrivals")
    return ingest.file_stream(spark, landed.inputFiles()[0].rsplit("/", 1)[0], landed.schema, files_per_batch=2)


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")
    job = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")
    ingest.run_available(stream, job, scratch_path(spark, "mark"), mode)
    return spark.read.parquet(out).drop("b")


@query("SELECT event_id AS id FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return _run(ingest.once(_arrivals(spark, d), ["id"], within="60 days")).select("id")


@query(None)
def stream_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per site the rows above its watermark, as state across batches; the last update of each."""
    out = _run(ingest.running_counts(_arrivals(spark, d), "site"), "update")
    return out.groupBy("site").agg(F.max_by(F.struct("n", "watermark_id"), "batch").alias("x")).select("site", "x.*")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {jr('avg(value)', 4)} AS avg_frp FROM events GROUP BY 1")
def daily_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.daily_counts(V.hotspots(spark, d))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", N.js_round("avg_frp", 4).alias("avg_frp"))


# ---- streams over files that come in order, with late rows
SLICES_SQL = """arrived AS (SELECT event_id AS id, ts AS seen, value AS frp,
  CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 1 WHEN ts < TIMESTAMP '2024-01-20' AND event_id % 7 > 0 THEN 2 WHEN ts < TIMESTAMP '2024-01-20' THEN 4 WHEN event_id % 11 > 0 THEN 3 ELSE 5 END AS slice FROM events),
tops AS (SELECT slice, max(seen) AS top FROM arrived GROUP BY 1),
marks AS (SELECT s.slice, (SELECT max(top) FROM tops p WHERE p.slice < s.slice - 1) - INTERVAL 72 HOUR AS mark FROM tops s)"""  # what counts as late is known one batch after the watermark


def _in_slices(spark: SparkSession, d: str, last: int = 5) -> DataFrame:
    """Detections landed in five files one after the other: by time, but a seventh of the second span and an eleventh of the third come after the rest of the third."""
    h, at = V.hotspots(spark, d).select("id", "acquired_at", "frp"), F.col("acquired_at")
    early, middle = at < F.lit("2024-01-10").cast("timestamp"), at < F.lit("2024-01-20").cast("timestamp")
    slice_ = F.when(early, 1).when(middle & (F.col("id") % 7 > 0), 2).when(middle, 4).when(F.col("id") % 11 > 0, 3).otherwise(5)
    sliced = materialize(h.withColumn("slice", slice_), "slices")
    path = scratch_path(spark, "arriving")
    for k in range(1, last + 1):
        sliced.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(path)
    return ingest.file_stream(spark, path, sliced.drop("slice").schema, files_per_batch=1)


@query(f"""WITH {SLICES_SQL}, end_ AS (SELECT max(seen) - INTERVAL 72 HOUR AS t FROM arrived),
k AS (SELECT a.seen::DATE AS day, a.frp FROM arrived a JOIN marks m USING (slice) WHERE m.mark IS NULL OR date_trunc('day', a.seen) + INTERVAL 1 DAY > m.mark)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, {jr('avg(frp)', 4)} AS avg_frp FROM k, end_ WHERE day + INTERVAL 1 DAY <= t GROUP BY day""")
def stream_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    """Days as windows of a stream in append mode: a day comes out once the watermark has passed it; rows that come later than that are dropped."""
    out = _run(ingest.daily_counts(_in_slices(spark, d)))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", N.js_round("avg_frp", 4).alias("avg_frp"))


@query(f"""WITH {SLICES_SQL}, s AS (SELECT id % 50 AS site, id, slice FROM arrived), m AS (SELECT site, slice, max(id) AS top FROM s GROUP BY ALL),
p AS (SELECT site, slice, max(top) OVER (PARTITION BY site ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT site, count(*) FILTER (before IS NULL OR id > before) AS n, max(id) AS watermark_id FROM s JOIN p USING (site, slice) GROUP BY site""")
def stream_state_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Per site the rows above the largest id of all batches before, as state across batches that come in order."""
    out = _run(ingest.running_counts(_in_slices(spark, d).withColumn("site", F.col("id") % 50), "site"), "update")
    return out.groupBy("site").agg(F.max_by(F.struct("n", "watermark_id"), "batch").alias("x")).select("site", "x.*")


@query(f"""WITH {SLICES_SQL}, end_ AS (SELECT max(seen) - INTERVAL 72 HOUR AS t FROM arrived), a AS (SELECT * FROM arrived WHERE slice < 4),
g AS (SELECT id % 50 AS site, seen, CASE WHEN seen - lag(seen) OVER w < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY id % 50 ORDER BY seen)),
s AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g),
w AS (SELECT site, min(seen) AS first_seen, max(seen) + INTERVAL 5 HOUR AS ends, count(*) AS n FROM s GROUP BY site, k)
SELECT site, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(ends, '%Y-%m-%d %H:%M:%S') AS ends, n FROM w WHERE ends <= (SELECT max(seen) FROM a) - INTERVAL 72 HOUR""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Spells of activity of a site, five hours apart, from a stream in append mode over the files that come in time order."""
    out = _run(ingest.sessions(_in_slices(spark, d, last=3).withColumn("site", F.col("id") % 50), ["site"], gap="5 hours"))
    return out.select("site", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "ends")], "n")


@query(f"""WITH {SLICES_SQL}, end_ AS (SELECT max(seen) - INTERVAL 72 HOUR AS t FROM arrived),
k AS (SELECT a.id % 997 AS site, a.seen, a.slice FROM arrived a JOIN marks m USING (slice) WHERE m.mark IS NULL OR a.seen >= m.mark),
f AS (SELECT *, max(seen) OVER (PARTITION BY site ORDER BY slice, seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM k),
e AS (SELECT site, seen, lag(seen) OVER (PARTITION BY site ORDER BY seen) AS before, lead(seen) OVER (PARTITION BY site ORDER BY seen) AS next FROM f WHERE top IS NULL OR seen > top),
turns AS (SELECT site, 'active' AS status, seen AS turned FROM e WHERE before IS NULL OR seen - before > INTERVAL 48 HOUR UNION ALL SELECT site, 'inactive', seen + INTERVAL 48 HOUR FROM e, end_ WHERE next - seen > INTERVAL 48 HOUR OR (next IS NULL AND seen + INTERVAL 48 HOUR <= t))
SELECT site, status, strftime(turned, '%Y-%m-%d %H:%M:%S') AS turned_at FROM turns""")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Sites that turn active and, 48 hours after their last point, inactive, by timers; some rows come late, some too late."""
    key, store = ingest.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        out = _run(ingest.activity(_in_slices(spark, d).withColumn("site", F.col("id") % 997), "site"))
    finally:
        spark.conf.set(key, before)
    return out.select("site", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("turned_at"))


# ---- last good values: loads by area and source; every third load of some areas fails for a week
LOADS_SQL = """loads AS (SELECT (user_id % 20)::BIGINT AS area, event_type AS source, ts AS seen, event_id % 4 <> 0 AND NOT (user_id % 5 = 2 AND day(ts) BETWEEN 9 AND 16) AS ok, value FROM events),
asks AS (SELECT event_id AS ask, (user_id * 7 % 23)::BIGINT AS area, event_type AS source, ts - INTERVAL 90 MINUTE AS seen FROM events)"""


def _loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, u = table(spark, d, "events"), F.col("user_id")
    at = F.col("ts").cast("timestamp")
    ok = (F.col("event_id") % 4 != 0) & ~((u % 5 == 2) & F.dayofmonth("ts").between(9, 16))
    loads = e.select((u % 20).alias("area"), F.col("event_type").alias("source"), at.alias("at"), ok.alias("ok"), "value", "event_id")
    return loads, e.select(F.col("event_id").alias("ask"), (u * 7 % 23).alias("area"), F.col("event_type").alias("source"), (at - F.expr("INTERVAL '90' MINUTE")).alias("at"))


@query(f"""WITH {LOADS_SQL}, once AS (SELECT area, source, seen, bool_or(ok) AS ok, max(value) FILTER (ok) AS value FROM loads GROUP BY ALL), goods AS (SELECT * FROM once WHERE ok)
SELECT a.ask, a.area, a.source, CASE WHEN g.seen IS NULL THEN 'none' WHEN l.ok THEN 'live' ELSE 'last good' END AS status, g.value, strftime(g.seen, '%Y-%m-%d %H:%M:%S') AS valid_at
FROM asks a ASOF LEFT JOIN goods g ON a.area = g.area AND a.source = g.source AND a.seen >= g.seen ASOF LEFT JOIN once l ON a.area = l.area AND a.source = l.source AND a.seen >= l.seen""")
def last_good_by_area(spark: SparkSession, d: str) -> DataFrame:
    """For each question about an area and a source at a time, the newest valid value and whether it is live."""
    loads, asks = _loads(spark, d)
    out = last_good.as_of(asks, loads, ["area", "source"])
    return out.select("ask", "area", "source", "status", "value", F.date_format("valid_at", "yyyy-MM-dd HH:mm:ss").alias("valid_at"))


@query(f"""WITH {LOADS_SQL}, n AS (SELECT area, seen::DATE AS day, source, max(seen) AS seen, arg_max(ok, (seen, ok)) AS ok FROM loads GROUP BY ALL), kinds AS (SELECT DISTINCT event_type AS source FROM events),
b AS (SELECT area, day, max(seen) AS seen, count(*) FILTER (ok) = (SELECT count(*) FROM kinds) AS complete, count(*) FILTER (ok)::BIGINT AS valid FROM n GROUP BY ALL)
SELECT area, strftime(day, '%Y-%m-%d') AS day, complete, (SELECT count(*) FROM kinds) - valid AS missing, strftime(max(CASE WHEN complete THEN day END) OVER (PARTITION BY area ORDER BY day), '%Y-%m-%d') AS shown FROM b""")
def complete_builds(spark: SparkSession, d: str) -> DataFrame:
    """A build for each area and day; only those with a valid part of every source become the one shown, else the last complete one stays."""
    loads, _ = _loads(spark, d)
    kinds = sorted(r[0] for r in loads.select("source").distinct().collect())  # the registry of sources
    builds = materialize(last_good.settled(loads.withColumns({"day": F.to_date("at"), "error": F.lit("failed")}), ["area", "day"], kinds), "builds")
    asked = builds.select("area", "day", F.col("day").cast("timestamp").alias("at"), "complete", F.size("missing").cast("long").alias("missing"))
    tried = builds.select("area", F.col("day").cast("timestamp").alias("at"), F.col("complete").alias("ok"), F.date_format("day", "yyyy-MM-dd").alias("value"))
    out = last_good.as_of(asked, tried, ["area"], span="month")
    return out.select("area", F.date_format("day", "yyyy-MM-dd").alias("day"), "complete", "missing", F.col("value").alias("shown"))

"""Queries on detections, incidents and the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlens.functions import numeric as N, text as T
from emberlens.operators import feed, incidents as I, spatial
from emberlens.plans import views as V
from emberlens.plans.views import H_SQL, INCIDENTS_SQL, hav, jr, query
from emberlens.session import table
from emberlens.shared import materialize, whole_side
from emberlens.sources import readers, sinks

DAY = "strftime({}, '%Y-%m-%d')"


def day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def stamp(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {jr('avg(value)', 4)} AS avg_frp FROM events GROUP BY 1")
def daily_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), N.js_round(F.avg("value"), 4).alias("avg_frp")).orderBy("day")


@query(f"WITH {H_SQL}, s AS (SELECT id, lat, CASE WHEN lon + 75 > 180 THEN lon + 75 - 360 ELSE lon + 75 END AS lon FROM h) SELECT id, {jr('lon', 6)} AS lon FROM s WHERE lat BETWEEN 52 AND 55 AND CASE WHEN lon < 0 THEN lon + 360 ELSE lon END BETWEEN 178 AND 183")
def hotspot_bbox_wrap(spark: SparkSession, d: str) -> DataFrame:
    east = F.col("lon") + 75.0
    h = V.hotspots(spark, d).withColumn("lon", F.when(east > 180, east - 360.0).otherwise(east))
    return h.where(N.in_bbox("lat", "lon", 178, 52, 183, 55)).select("id", N.js_round("lon", 6).alias("lon"))


CODES = ["h", " Nominal ", "l", "81", "30.5", "12", "x", ""]
CODE_SQL = "['h', ' Nominal ', 'l', '81', '30.5', '12', 'x', ''][(event_id % 8 + 1)::INT]"


@query(f"""WITH c AS (SELECT event_id, lower(trim({CODE_SQL})) AS v FROM events)
SELECT CASE WHEN v IN ('h', 'high') THEN 'high' WHEN v IN ('n', 'nominal') THEN 'nominal' WHEN v IN ('l', 'low') THEN 'low'
  WHEN try_cast(v AS DOUBLE) >= 80 THEN 'high' WHEN try_cast(v AS DOUBLE) >= 30 THEN 'nominal' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'low' END AS confidence, count(*) AS n FROM c GROUP BY 1""")
def confidence_normalize(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").groupBy(T.normalize_confidence(code).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {H_SQL} SELECT id, frp FROM h QUALIFY row_number() OVER (PARTITION BY floor(lat * 100 + 0.5), floor(lon * 100 + 0.5) ORDER BY frp DESC, id) = 1")
def dedupe_max_frp_grid(spark: SparkSession, d: str) -> DataFrame:
    h = V.hotspots(spark, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return sinks.dedupe_grid(h.select("id", "frp", "latitude", "longitude"), [F.col("id")]).select("id", "frp")


@query(f"""WITH {H_SQL}, o AS (SELECT id, satellite, acquired_at, lat::DECIMAL(9, 6) AS lat, lon::DECIMAL(10, 6) AS lon FROM h)
SELECT id FROM o WHERE (id % 2 = 0 OR id % 10 = 1) AND NOT EXISTS (SELECT 1 FROM o s WHERE s.id % 2 = 1 AND s.satellite = o.satellite AND s.acquired_at = o.acquired_at AND s.lat = o.lat AND s.lon = o.lon)""")
def anti_join_new_observations(spark: SparkSession, d: str) -> DataFrame:
    h = V.hotspots(spark, d).select("id", "satellite", "acquired_at", F.col("lat").cast("decimal(9,6)").alias("latitude"), F.col("lon").cast("decimal(10,6)").alias("longitude"))
    return sinks.new_observations(h.where("id % 2 = 0 OR id % 10 = 1"), h.where("id % 2 = 1"), ["satellite", "acquired_at", "latitude", "longitude"]).select("id")


@query(f"WITH {H_SQL} SELECT id FROM h WHERE acquired_at::DATE >= (SELECT max(acquired_at) FROM h)::DATE - 10")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    h = V.hotspots(spark, d)
    return sinks.keep_recent(h.withColumn("acquisition_date", F.to_date("acquired_at")), V.newest(h), 10).select("id")


# ---- feed
def _feed_sql(where: str, order: str, limit: int, offset: int = 0) -> str:
    return f"WITH {INCIDENTS_SQL} SELECT id, strftime(detected_date, '%Y-%m-%d') AS detected_date, area_ha, confidence, region, forest_area_name FROM f WHERE {where} ORDER BY {order}, id DESC LIMIT {limit} OFFSET {offset}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", day("detected_date").alias("detected_date"), "area_ha", "confidence", "region", "forest_area_name")


NOT_STATIC = "coalesce(status, '') <> 'static_source'"


@query(_feed_sql(NOT_STATIC, "detected_date DESC", 12))
def feed_page_date_desc(spark: SparkSession, d: str) -> DataFrame:
    return _shown(feed.page(V.incidents(spark, d), V.areas(spark, d), {"sort": "nothing", "limit": "x"}))


@query(_feed_sql("region = 'BUILDING' AND source = 'firms'", "area_ha ASC NULLS LAST", 25, 5))
def feed_page_area_asc(spark: SparkSession, d: str) -> DataFrame:
    return _shown(feed.page(V.incidents(spark, d), V.areas(spark, d), {"sort": "area_asc", "limit": "25", "offset": "5", "region": "BUILDING", "source": "firms", "static_sources": "include"}))


@query(_feed_sql(f"{NOT_STATIC} AND status = 'active' AND detected_date BETWEEN '1995-01-01' AND '1997-12-31'", "confidence DESC NULLS LAST, detected_date DESC", 100))
def feed_page_confidence_desc(spark: SparkSession, d: str) -> DataFrame:
    return _shown(feed.page(V.incidents(spark, d), V.areas(spark, d), {"sort": "confidence_desc", "limit": "9999", "status": ["active"], "start_date": "1995-01-01", "end_date": "1997-12-31", "id": "-3"}))


@query(f"WITH {INCIDENTS_SQL} SELECT count(*) AS total FROM f WHERE status = 'static_source'")
def feed_total_count(spark: SparkSession, d: str) -> DataFrame:
    return feed.total(V.incidents(spark, d), V.areas(spark, d), {"static_sources": "only", "start_date": "2023-02-30"})


@query(f"WITH {INCIDENTS_SQL} SELECT area_region AS region FROM a WHERE area_region IS NOT NULL UNION SELECT own_region FROM i WHERE own_region IS NOT NULL")
def feed_regions_union(spark: SparkSession, d: str) -> DataFrame:
    return feed.regions(V.incidents(spark, d), V.areas(spark, d)).orderBy("region")


@query(f"WITH {INCIDENTS_SQL} SELECT DISTINCT source FROM i")
def feed_sources_distinct(spark: SparkSession, d: str) -> DataFrame:
    return V.incidents(spark, d).select("source").distinct()


@query(_feed_sql(NOT_STATIC, "detected_date DESC", 500))
def map_layer_limit(spark: SparkSession, d: str) -> DataFrame:
    return _shown(feed.map_layer(V.incidents(spark, d), V.areas(spark, d), {"source": "ignored"}))


@query(_feed_sql(NOT_STATIC, "area_ha DESC NULLS LAST", 5001))
def export_limit_probe(spark: SparkSession, d: str) -> DataFrame:
    return _shown(feed.export(V.incidents(spark, d), V.areas(spark, d), {"sort": "area_desc"}))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k')::INT % 5 = 2")
def json_status_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(k.cast("int") % 5 == 2).select("event_id", k.alias("k"))


@query(f"WITH {INCIDENTS_SQL} SELECT change_type, count(*) AS n, count(*) FILTER (status = 'active') AS active FROM i GROUP BY 1")
def changes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return V.incidents(spark, d).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("active"))


# ---- exports
def _cell(c: str) -> str:
    v = f"coalesce({c}, '')"
    v = f"CASE WHEN regexp_matches({v}, '^[=+\\-@\\t\\r]') THEN '''' || {v} ELSE {v} END"
    return f"CASE WHEN regexp_matches({v}, '[\",\\r\\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END"


@query(f"""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN 'a,"b"' WHEN 2 THEN NULL WHEN 3 THEN '-x' ELSE event_type END AS note, value FROM events)
SELECT event_id, concat_ws(',', event_id::VARCHAR, {_cell('note')}, (event_id % 7 - 3)::VARCHAR) AS line FROM t""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 5
    note = F.when(m == 0, "=1+1").when(m == 1, 'a,"b"').when(m == 2, F.lit(None)).when(m == 3, "-x").otherwise(F.col("event_type"))
    t = table(spark, d, "events").select("event_id", note.alias("note"), (F.col("event_id") % 7 - 3).alias("offset"))
    return t.select("event_id", T.csv_line([("event_id", False), ("note", True), ("offset", False)]).alias("line"))


@query(f"""WITH {H_SQL}, b AS (SELECT id, satellite, CASE WHEN id % 3 = 0 THEN NULL ELSE lon END AS lon, lat, lon - 0.01 * (id % 2) AS w_, lat - 0.01 AS s_, lon + 0.01 * (id % 2) AS e_, lat + 0.01 AS n_ FROM h)
SELECT id, '{{"type":"Feature","geometry":' || CASE WHEN e_ > w_ THEN format('{{{{"type":"Polygon","coordinates":[[[{{:.6f}},{{:.6f}}],[{{:.6f}},{{:.6f}}],[{{:.6f}},{{:.6f}}],[{{:.6f}},{{:.6f}}],[{{:.6f}},{{:.6f}}]]]}}}}', w_, s_, e_, s_, e_, n_, w_, n_, w_, s_)
  WHEN lon IS NOT NULL THEN format('{{{{"type":"Point","coordinates":[{{:.6f}},{{:.6f}}]}}}}', lon, lat) ELSE 'null' END || ',"properties":{{"id":' || id || ',"satellite":"' || satellite || '"}}}}' AS feature FROM b""")
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    odd = (F.col("id") % 2).cast("double") * 0.01
    b = V.hotspots(spark, d).select("id", "satellite", F.when(F.col("id") % 3 != 0, F.col("lon")).alias("lon"), "lat", (F.col("lon") - odd).alias("w"), (F.col("lat") - 0.01).alias("s"), (F.col("lon") + odd).alias("e"), (F.col("lat") + 0.01).alias("n"))
    return b.select("id", feed.feature_json(feed.geometry_json(F.lit(None).cast("string"), "w", "s", "e", "n", "lon", "lat"), ["id", "satellite"]).alias("feature"))


# ---- static sources
CELLS_SQL = """hr AS (SELECT *, floor(lat / 0.004::DOUBLE)::BIGINT AS r FROM h),
hc AS (SELECT *, floor(lon * cos((r + 0.5::DOUBLE) * 0.004::DOUBLE * pi() / 180) / 0.004::DOUBLE)::BIGINT AS c FROM hr),
cells AS (SELECT r, c, avg(lat) AS lat, avg(lon) AS lon, list_sort(list_distinct(list(acquired_at::DATE))) AS days FROM hc {where} GROUP BY r, c HAVING count(DISTINCT acquired_at::DATE) >= 2)"""


@query(f"WITH {H_SQL}, {CELLS_SQL.format(where='')} SELECT r AS \"row\", c AS \"col\", {jr('lat', 8)} AS lat, {jr('lon', 8)} AS lon, len(days) AS n_days, strftime(days[1], '%Y-%m-%d') AS first_day FROM cells")
def heat_cells(spark: SparkSession, d: str) -> DataFrame:
    c = I.heat_cells(V.hotspots(spark, d))
    return c.select("row", "col", N.js_round("lat", 8).alias("lat"), N.js_round("lon", 8).alias("lon"), F.size("days").cast("long").alias("n_days"), day(F.element_at("days", 1)).alias("first_day"))


@query(f"""WITH {H_SQL}, {CELLS_SQL.format(where="WHERE acquired_at::DATE >= (SELECT max(acquired_at) FROM h)::DATE - 13")},
near AS (SELECT w.id, unnest(c.days) AS day FROM w JOIN cells c ON abs(w.lat - c.lat) < 0.01 AND {hav('w.lat', 'w.lon', 'c.lat', 'c.lon')} <= 0.5)
SELECT id, count(DISTINCT day) AS n_days FROM near GROUP BY id HAVING count(DISTINCT day) >= 4 AND max(day) - min(day) >= 7""")
def static_points(spark: SparkSession, d: str) -> DataFrame:
    h = V.hotspots(spark, d)
    recent = h.where(F.to_date("acquired_at") >= F.date_sub(F.to_date(V.newest(h)), I.STATIC_WINDOW_DAYS - 1))
    near = I.days_near(V.recent(spark, d), I.heat_cells(recent)).where(I.is_static(F.col("days")))
    return near.select("id", F.size("days").cast("long").alias("n_days"))


# ---- clusters and incidents
@query(f"WITH {H_SQL} SELECT a.id AS a, b.id AS b, {jr(hav('a.lat', 'a.lon', 'b.lat', 'b.lon'), 6)} AS km FROM w a JOIN w b ON a.id < b.id AND abs(a.lat - b.lat) < 0.02 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2")
def distance_pairs_2km(spark: SparkSession, d: str) -> DataFrame:
    return spatial.distance_pairs(V.recent(spark, d), 2.0).select("a", "b", N.js_round("km", 6).alias("km"))


CLUSTERS_SQL = f"""pair AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.02 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2),
reach AS (SELECT id, id AS seed FROM w UNION SELECT p.b, r.seed FROM reach r JOIN pair p ON p.a = r.id),
cl AS (SELECT id, min(seed) AS cluster FROM reach GROUP BY id)"""


@query(f"WITH RECURSIVE {H_SQL}, {CLUSTERS_SQL} SELECT id, cluster FROM cl")
def single_linkage_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.single_linkage(V.recent(spark, d), 2.0)


# detections of the window without those at static sources
KEPT_SQL = H_SQL.replace("w AS (SELECT * FROM h", "w0 AS (SELECT * FROM h") + f""", {CELLS_SQL.format(where="WHERE acquired_at::DATE >= (SELECT max(acquired_at) FROM h)::DATE - 13")},
near_days AS (SELECT w0.id, unnest(c.days) AS day FROM w0 JOIN cells c ON abs(w0.lat - c.lat) < 0.01 AND {hav('w0.lat', 'w0.lon', 'c.lat', 'c.lon')} <= 0.5),
still AS (SELECT id FROM near_days GROUP BY id HAVING count(DISTINCT day) >= 4 AND max(day) - min(day) >= 7),
w AS (SELECT * FROM w0 WHERE id NOT IN (SELECT id FROM still))"""
PIXEL_SQL = "floor(lat * 111.32::DOUBLE / 0.375::DOUBLE) || ':' || floor(lon * (cos((floor(lat * 111.32::DOUBLE / 0.375::DOUBLE) + 0.5) * 0.375::DOUBLE / 111.32::DOUBLE * pi() / 180) * 111.32::DOUBLE) / 0.375::DOUBLE)"
BUILD_SQL = f"""pw AS (SELECT w.*, cl.cluster, r.region FROM w JOIN cl USING (id) LEFT JOIN first_region r USING (id)),
built AS (SELECT cluster, arg_min(id, (acquired_at, id))::VARCHAR AS cluster_key, arg_min(coalesce(region, ''), (acquired_at, id)) AS region, count(*) AS hotspot_count, count(*) FILTER (confidence = 'high') AS high_count,
  count(DISTINCT {PIXEL_SQL}) AS pixel_count, max(frp) AS frp_max, {jr('sum(frp)', 2)} AS frp_sum, min(acquired_at) AS first_seen, max(acquired_at) AS last_seen, max(id) AS max_hotspot_id,
  {jr('avg(lat)', 6)} AS center_lat, {jr('avg(lon)', 6)} AS center_lng, min(lat) AS bbox_min_lat, min(lon) AS bbox_min_lng, max(lat) AS bbox_max_lat, max(lon) AS bbox_max_lng,
  string_agg(DISTINCT satellite, ',' ORDER BY satellite) AS satellite FROM pw GROUP BY cluster HAVING count(*) >= 2 OR bool_or(confidence = 'high'))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Detections of the window that aren't at static sources, with their region."""
    h, points = V.hotspots(spark, d), V.recent(spark, d)
    points, _ = I.split_static(points, I.static_points(points, h, V.newest(h)))
    region = spatial.first_region(points, spatial.edges_of(V.regions(spark, d)))
    return points.join(whole_side(region), "id", "left").withColumn("region_iso", F.col("region"))


@query(f"""WITH RECURSIVE {KEPT_SQL}, {V.EDGES_SQL}, {V.pip_sql('w')}, {CLUSTERS_SQL}, {BUILD_SQL}
SELECT cluster_key, nullif(region, '') AS region, hotspot_count, high_count, pixel_count, frp_max, frp_sum, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen,
  CASE WHEN (SELECT max(acquired_at) FROM h) - INTERVAL 48 HOUR > last_seen THEN 'inactive' ELSE 'active' END AS status, max_hotspot_id, center_lat, center_lng,
  {jr('pixel_count * 14.06::DOUBLE', 2)} AS area_ha, {jr('high_count / hotspot_count', 2)} AS confidence, satellite FROM built""")
def incident_build(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: detections of the last 72 hours to clusters to incident rows."""
    points = materialize(_points(spark, d), "points")
    built = I.build_incidents(I.cluster(points), V.newest(V.hotspots(spark, d)))
    return built.select(
        "cluster_key", "region", "hotspot_count", "high_count", "pixel_count", "frp_max", "frp_sum", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"),
        "status", "max_hotspot_id", "center_lat", "center_lng", "area_ha", "confidence", "satellite",
    )


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, F.Column]:
    """Points of the window, the state of a run 30 hours ago that knew those with an even id (incident_id: the cluster), and the time of this run."""
    points, as_of = materialize(_points(spark, d), "points"), V.newest(V.hotspots(spark, d))
    old = points.where("id % 2 = 0")
    built = materialize(I.build_incidents(I.cluster(old), as_of - F.expr("INTERVAL '30' HOUR")), "state")
    # the earlier run had counted only ids up to three quarters of its largest: what is above comes again
    state = built.withColumn("incident_id", F.col("cluster")).withColumn("max_hotspot_id", F.floor(F.col("max_hotspot_id") * 0.75)).select(*I.STATE)
    return points, state, as_of


STATE_SQL = f"""we AS (SELECT * FROM w WHERE id % 2 = 0),
pair0 AS (SELECT a.id AS a, b.id AS b FROM we a JOIN we b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.02 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2),
reach0 AS (SELECT id, id AS seed FROM we UNION SELECT p.b, r.seed FROM reach0 r JOIN pair0 p ON p.a = r.id),
cl0 AS (SELECT id, min(seed) AS cluster FROM reach0 GROUP BY id),
st AS (SELECT cluster AS incident_id, count(*) AS n0, count(*) FILTER (confidence = 'high') AS high0, count(DISTINCT {PIXEL_SQL}) AS px0, min(acquired_at) AS first0, max(acquired_at) AS last0, floor(max(id) * 0.75::DOUBLE)::BIGINT AS mark,
  arg_min(id, (acquired_at, id))::VARCHAR AS key0, arg_min(coalesce(region, ''), (acquired_at, id)) AS region0, max(frp) AS frp0, {jr('sum(frp)', 2)} AS sum0, {jr('avg(lat)', 6)} AS lat0, {jr('avg(lon)', 6)} AS lon0, list(DISTINCT satellite) AS sats0,
  min(lat) AS s, min(lon) AS w_, max(lat) AS n_, max(lon) AS e FROM we JOIN cl0 USING (id) LEFT JOIN first_region USING (id) GROUP BY cluster HAVING count(*) >= 2 OR bool_or(confidence = 'high')),
box AS (SELECT cluster, min(lat) AS s, min(lon) AS w_, max(lat) AS n_, max(lon) AS e FROM w JOIN cl USING (id) GROUP BY cluster),
gap AS (SELECT b.cluster, t.incident_id,
  CASE WHEN b.s > t.n_ THEN t.n_ WHEN t.s > b.n_ THEN b.n_ END AS la, CASE WHEN b.s > t.n_ THEN b.s WHEN t.s > b.n_ THEN t.s END AS lb,
  CASE WHEN b.w_ > t.e THEN t.e WHEN t.w_ > b.e THEN b.e END AS oa, CASE WHEN b.w_ > t.e THEN b.w_ WHEN t.w_ > b.e THEN t.w_ END AS ob,
  (greatest(b.s, t.s) + least(b.n_, t.n_)) / 2 AS mid FROM box b JOIN st t ON b.s - t.n_ < 0.1 AND t.s - b.n_ < 0.1),
far AS (SELECT cluster, incident_id, CASE WHEN la IS NULL THEN 0 ELSE {hav('la', '0', 'lb', '0')} END AS y, CASE WHEN oa IS NULL THEN 0 ELSE {hav('coalesce((la + lb) / 2, mid)', 'oa', 'coalesce((la + lb) / 2, mid)', 'ob')} END AS x FROM gap),
hit AS (SELECT cluster, arg_min(incident_id, (sqrt(x * x + y * y), incident_id)) AS incident_id FROM far WHERE sqrt(x * x + y * y) <= 2 GROUP BY cluster),
pm AS (SELECT w.*, hit.incident_id, w.id > st.mark AS fresh, {PIXEL_SQL} AS pixel FROM w JOIN cl USING (id) JOIN hit USING (cluster) JOIN st USING (incident_id)),
px AS (SELECT incident_id, count(*) AS new_px FROM (SELECT incident_id, pixel FROM pm GROUP BY ALL HAVING bool_and(fresh)) GROUP BY 1),
up AS (SELECT incident_id, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, max(id) AS top, max(frp) AS frp1, sum(frp) AS sum1, min(acquired_at) AS first1, max(acquired_at) AS last1, sum(lat) AS lat1, sum(lon) AS lon1,
  min(lat) AS s1, min(lon) AS w1, max(lat) AS n1, max(lon) AS e1, list(DISTINCT satellite) AS sats1 FROM pm WHERE fresh GROUP BY 1)"""


@query(f"""WITH RECURSIVE {KEPT_SQL}, {V.EDGES_SQL}, {V.pip_sql('w')}, {CLUSTERS_SQL}, {STATE_SQL}
SELECT incident_id, key0 AS cluster_key, nullif(region0, '') AS region_iso, nullif(region0, '') AS region, n0 + n AS hotspot_count, high0 + high AS high_count, px0 + coalesce(new_px, 0) AS pixel_count, greatest(frp0, frp1) AS frp_max, {jr('sum0 + sum1', 2)} AS frp_sum,
  strftime(least(first0, first1), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(greatest(last0, last1), '%Y-%m-%d %H:%M:%S') AS last_seen, CASE WHEN (SELECT max(acquired_at) FROM h) - INTERVAL 48 HOUR > greatest(last0, last1) THEN 'inactive' ELSE 'active' END AS status,
  greatest(mark, top) AS max_hotspot_id, {jr('(lat0 * n0 + lat1) / (n0 + n)', 6)} AS center_lat, {jr('(lon0 * n0 + lon1) / (n0 + n)', 6)} AS center_lng, least(s, s1) AS bbox_min_lat, least(w_, w1) AS bbox_min_lng, greatest(n_, n1) AS bbox_max_lat, greatest(e, e1) AS bbox_max_lng,
  array_to_string(list_sort(list_distinct(list_concat(sats0, sats1))), ',') AS satellite FROM up JOIN st USING (incident_id) LEFT JOIN px USING (incident_id)""")
def incident_merge_watermark(spark: SparkSession, d: str) -> DataFrame:
    points, state, as_of = _state(spark, d)
    clustered = materialize(I.cluster(points), "clustered")
    merged = I.merge_incidents(clustered.join(I.match_clusters(clustered, state, as_of), "cluster"), state, as_of)
    return merged.select(*[stamp(c).alias(c) if c in ("first_seen", "last_seen") else F.col(c) for c in I.STATE])


@query(f"""WITH RECURSIVE {KEPT_SQL}, {V.EDGES_SQL}, {V.pip_sql('w')}, {CLUSTERS_SQL}, {STATE_SQL}
SELECT 'update' AS action, incident_id AS id FROM up UNION ALL
SELECT 'create', cluster FROM w JOIN cl USING (id) WHERE cluster NOT IN (SELECT cluster FROM hit) GROUP BY cluster HAVING count(*) >= 2 OR bool_or(confidence = 'high') UNION ALL
SELECT 'status', incident_id FROM st WHERE incident_id NOT IN (SELECT incident_id FROM up) AND last0 < (SELECT max(acquired_at) FROM h) - INTERVAL 48 HOUR""")
def incident_plan_actions(spark: SparkSession, d: str) -> DataFrame:
    points, state, as_of = _state(spark, d)
    creates, updates, changes = I.plan(materialize(I.cluster(points), "clustered"), state, as_of)
    act = lambda df, name, c: df.select(F.lit(name).alias("action"), F.col(c).alias("id"))
    return act(updates, "update", "incident_id").union(act(creates, "create", "cluster")).union(act(changes, "status", "incident_id"))


# detections west of 103 degrees stand at few places, as flares do
FLARES_SQL = H_SQL.replace("h AS (", "h0 AS (", 1).replace("w AS (", """h AS (SELECT id, acquired_at, frp, satellite, confidence, CASE WHEN lon < 103 THEN floor(lat * 10) / 10 ELSE lat END AS lat, CASE WHEN lon < 103 THEN floor(lon * 10) / 10 ELSE lon END AS lon FROM h0),
w AS (""", 1)


@query(f"""WITH RECURSIVE {FLARES_SQL}, {CLUSTERS_SQL}, {CELLS_SQL.format(where="WHERE acquired_at::DATE >= (SELECT max(acquired_at) FROM h)::DATE - 13")},
b AS (SELECT cluster, min(lat) AS s, min(lon) AS w_, max(lat) AS n_, max(lon) AS e, max(id) AS top, min(acquired_at)::DATE AS d0, max(acquired_at)::DATE AS d1 FROM w JOIN cl USING (id) GROUP BY cluster HAVING count(*) >= 2 OR bool_or(confidence = 'high')),
near_days AS (SELECT h.id, unnest(c.days) AS day FROM h JOIN cells c ON abs(h.lat - c.lat) < 0.01 AND {hav('h.lat', 'h.lon', 'c.lat', 'c.lon')} <= 0.5),
still AS (SELECT id, 1 AS hit FROM near_days GROUP BY id HAVING count(DISTINCT day) >= 4 AND max(day) - min(day) >= 7)
SELECT b.cluster AS incident_id FROM b JOIN h ON h.lat BETWEEN b.s AND b.n_ AND h.lon BETWEEN b.w_ AND b.e AND h.acquired_at::DATE BETWEEN b.d0 AND b.d1 AND h.id <= b.top LEFT JOIN still USING (id) GROUP BY 1 HAVING count(*) = count(hit)""")
def static_incident_relabel(spark: SparkSession, d: str) -> DataFrame:
    """Incidents of a run that knew no mask, of which every observation is at a static source."""
    h = _flares(spark, d)
    as_of = V.newest(h)
    points = I.in_window(h, as_of)
    state = materialize(I.build_incidents(I.cluster(points), as_of).withColumn("incident_id", F.col("cluster")).select(*I.STATE), "state")
    return I.static_relabels(state, h, h, as_of)


ERAS = {1: (90, 18), 2: (240, 192), 3: (528, 480)}


def _eras_sql() -> str:
    """CTE st0: what earlier runs that knew no mask had stored: incidents of three spells (hours before the newest detection), the last of them long ago."""
    parts = []
    for k, (a, b) in ERAS.items():
        parts.append(f"""e{k} AS (SELECT * FROM h WHERE acquired_at >= (SELECT max(acquired_at) FROM h) - INTERVAL {a} HOUR AND acquired_at < (SELECT max(acquired_at) FROM h) - INTERVAL {b} HOUR AND id % 3 > 0),
ep{k} AS (SELECT a.id AS a, b.id AS b FROM e{k} a JOIN e{k} b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.02 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2),
er{k} AS (SELECT id, id AS seed FROM e{k} UNION SELECT p.b, r.seed FROM er{k} r JOIN ep{k} p ON p.a = r.id),
ec{k} AS (SELECT id, min(seed) AS cluster FROM er{k} GROUP BY id)""")
    state = " UNION ALL ".join(
        f"SELECT {k}::BIGINT * 1000000000 + cluster AS incident_id, min(acquired_at) AS first0, max(acquired_at) AS last0, max(id) AS mark, min(lat) AS s, min(lon) AS w_, max(lat) AS n_, max(lon) AS e, CASE WHEN {k} = 3 AND cluster % 2 = 1 THEN 'inactive' ELSE 'active' END AS status FROM e{k} JOIN ec{k} USING (id) GROUP BY cluster HAVING count(*) >= 2 OR bool_or(confidence = 'high')" for k in ERAS
    )
    return ", ".join(parts) + f", st0 AS ({state})"


TOUCH_SQL = f"""{_eras_sql()}, {CELLS_SQL.format(where="WHERE acquired_at::DATE >= (SELECT max(acquired_at) FROM h)::DATE - 13")},
cell_days AS (SELECT a.r, a.c, any_value(a.lat) AS lat, any_value(a.lon) AS lon, list(DISTINCT d) AS days FROM (SELECT a.*, unnest(b.days) AS d FROM cells a JOIN cells b ON abs(a.lat - b.lat) < 0.01 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 0.5) a GROUP BY a.r, a.c),
spot AS (SELECT lat, lon, 0.5 / 111.32::DOUBLE AS py, 0.5 / 111.32::DOUBLE / greatest(0.01, cos(lat * pi() / 180)) AS px FROM cell_days WHERE len(days) >= 4 AND list_max(days) - list_min(days) >= 7),
open0 AS (SELECT * FROM st0 WHERE status = 'active' OR last0::DATE >= (SELECT max(acquired_at) FROM h)::DATE - 13),
touched AS (SELECT * FROM open0 WHERE EXISTS (SELECT 1 FROM spot WHERE spot.lat BETWEEN s - py AND n_ + py AND spot.lon BETWEEN w_ - px AND e + px)),
near_days AS (SELECT h.id, unnest(c.days) AS day FROM h JOIN cells c ON abs(h.lat - c.lat) < 0.01 AND {hav('h.lat', 'h.lon', 'c.lat', 'c.lon')} <= 0.5),
still AS (SELECT id, 1 AS hit FROM near_days GROUP BY id HAVING count(DISTINCT day) >= 4 AND max(day) - min(day) >= 7),
gone AS (SELECT incident_id FROM touched t JOIN h ON h.lat BETWEEN t.s AND t.n_ AND h.lon BETWEEN t.w_ AND t.e AND h.acquired_at::DATE BETWEEN t.first0::DATE AND t.last0::DATE AND h.id <= t.mark LEFT JOIN still USING (id) GROUP BY 1 HAVING count(*) = count(hit))"""


def _flares(spark: SparkSession, d: str) -> DataFrame:
    west, snap = F.col("lon") < 103, lambda c: F.floor(F.col(c) * 10).cast("double") / 10
    h = V.hotspots(spark, d).select("id", "acquired_at", "frp", "satellite", "confidence", F.when(west, snap("lat")).otherwise(F.col("lat")).alias("lat"), F.when(west, snap("lon")).otherwise(F.col("lon")).alias("lon"))
    return h.withColumns({"region": F.lit(None).cast("string"), "region_iso": F.lit(None).cast("string")})


def _eras(h: DataFrame, as_of) -> DataFrame:
    """The state before the run: see _eras_sql."""
    ago = lambda hours: as_of - F.expr(f"INTERVAL '{hours}' HOUR")
    spells = []
    for k, (a, b) in ERAS.items():
        built = I.build_incidents(I.cluster(h.where((F.col("acquired_at") >= ago(a)) & (F.col("acquired_at") < ago(b)) & (F.col("id") % 3 > 0))), as_of)
        status = F.when((F.lit(k) == 3) & (F.col("cluster") % 2 == 1), "inactive").otherwise("active")
        spells.append(built.withColumn("incident_id", F.lit(k * 1_000_000_000) + F.col("cluster")).withColumn("status", status).select(*I.STATE))
    return materialize(spells[0].union(spells[1]).union(spells[2]), "state")


@query(f"WITH RECURSIVE {FLARES_SQL}, {TOUCH_SQL} SELECT s.incident_id, s.status, s.last0::DATE >= (SELECT max(acquired_at) FROM h)::DATE - 13 AS in_window, t.incident_id IS NOT NULL AS touched, g.incident_id IS NOT NULL AS relabelled FROM st0 s LEFT JOIN touched t USING (incident_id) LEFT JOIN gone g USING (incident_id)")
def static_touch(spark: SparkSession, d: str) -> DataFrame:
    """Of each stored incident whether a static place touches its box, and whether it becomes a static source: recent, quiet and long gone ones."""
    h = materialize(_flares(spark, d), "flares")
    as_of = V.newest(h)
    state = _eras(h, as_of)
    touched = materialize(I.touched_incidents(state, h, as_of), "touched")
    gone = I.relabelled(touched, h, h, as_of)
    marked = state.join(touched.select("incident_id", F.lit(True).alias("t")), "incident_id", "left").join(gone.withColumn("g", F.lit(True)), "incident_id", "left")
    return marked.select("incident_id", "status", (F.to_date("last_seen") >= I.window_start(as_of)).alias("in_window"), F.coalesce("t", F.lit(False)).alias("touched"), F.coalesce("g", F.lit(False)).alias("relabelled"))


@query(f"""WITH RECURSIVE {FLARES_SQL.replace("w AS (", "w0 AS (")}, {TOUCH_SQL}, w AS (SELECT * FROM w0 WHERE id NOT IN (SELECT id FROM still)), {CLUSTERS_SQL},
live AS (SELECT * FROM open0 WHERE incident_id NOT IN (SELECT incident_id FROM gone)), st AS (SELECT * FROM live WHERE last0 >= (SELECT max(acquired_at) FROM h) - INTERVAL 72 HOUR),
{STATE_SQL[STATE_SQL.index("box AS"):STATE_SQL.index("pm AS")].rstrip().rstrip(",")},
up AS (SELECT DISTINCT incident_id FROM w JOIN cl USING (id) JOIN hit USING (cluster) JOIN st USING (incident_id) WHERE w.id > st.mark)
SELECT 'relabel' AS action, incident_id AS id, 'static_source' AS what FROM gone UNION ALL SELECT 'update', incident_id, NULL FROM up UNION ALL
SELECT 'create', cluster, NULL FROM w JOIN cl USING (id) WHERE cluster NOT IN (SELECT cluster FROM hit) GROUP BY cluster HAVING count(*) >= 2 OR bool_or(confidence = 'high') UNION ALL
SELECT 'status', incident_id, CASE WHEN last0 < (SELECT max(acquired_at) FROM h) - INTERVAL 48 HOUR THEN 'inactive' ELSE 'active' END FROM live WHERE incident_id NOT IN (SELECT incident_id FROM up) AND status <> CASE WHEN last0 < (SELECT max(acquired_at) FROM h) - INTERVAL 48 HOUR THEN 'inactive' ELSE 'active' END UNION ALL
SELECT 'masked', count(*), NULL FROM w0 WHERE id IN (SELECT id FROM still)""")
def incident_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run: static incidents are relabelled first, points at static places left out, the rest clustered and planned against what is open."""
    h = materialize(_flares(spark, d), "flares")
    as_of = V.newest(h)
    state = _eras(h, as_of)
    window = materialize(I.in_window(h, as_of), "window")
    run = I.run(window, state, materialize(I.static_relabels(state, h, h, as_of), "relabels"), materialize(I.static_points(window, h, as_of), "static"), as_of)
    act = lambda df, name, c, what=None: df.select(F.lit(name).alias("action"), F.col(c).cast("long").alias("id"), (F.lit(None).cast("string") if what is None else what).alias("what"))
    parts = [act(run.relabels, "relabel", "incident_id", F.lit(I.STATIC_STATUS)), act(run.updates, "update", "incident_id"), act(run.creates, "create", "cluster"), act(run.changes, "status", "incident_id", F.col("status")), act(run.masked.agg(F.count(F.lit(1)).alias("n")), "masked", "n")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query(f"""WITH RECURSIVE {KEPT_SQL}, {V.EDGES_SQL}, {V.pip_sql('w')}, {CLUSTERS_SQL}, {BUILD_SQL},
b AS (SELECT cluster, first_seen::DATE AS d0, last_seen::DATE AS d1, max_hotspot_id AS top, bbox_min_lat - 0.375 / 111.32::DOUBLE AS s, bbox_max_lat + 0.375 / 111.32::DOUBLE AS n_,
  bbox_min_lng - 0.375 / 111.32::DOUBLE / greatest(0.01, cos(center_lat * pi() / 180)) AS w_, bbox_max_lng + 0.375 / 111.32::DOUBLE / greatest(0.01, cos(center_lat * pi() / 180)) AS e FROM built)
SELECT b.cluster AS incident_id, h.id, row_number() OVER (PARTITION BY b.cluster ORDER BY h.acquired_at DESC, h.id DESC)::INT AS rank
FROM b JOIN h ON h.lat BETWEEN b.s AND b.n_ AND h.lon BETWEEN b.w_ AND b.e AND h.acquired_at::DATE BETWEEN b.d0 AND b.d1 AND h.id <= b.top QUALIFY rank <= 5""")
def incident_hotspots_topk(spark: SparkSession, d: str) -> DataFrame:
    points = materialize(_points(spark, d), "points")
    state = I.build_incidents(I.cluster(points), V.newest(V.hotspots(spark, d))).withColumn("incident_id", F.col("cluster"))
    return I.incident_points(state, V.hotspots(spark, d), buffer_m=375.0, most=5)


# ---- exports with their metadata
STORED_SQL = f"""{INCIDENTS_SQL}, m AS (SELECT f.*, CASE WHEN id % 6 = 0 THEN '' ELSE 'RU-' || (id % 9) END AS region_iso, strftime(detected_date, '%Y-%m-%d') || 'T05:12:00Z' AS first_seen, CASE WHEN id % 5 = 0 THEN NULL ELSE strftime(detected_date + 1, '%Y-%m-%d') || 'T05:12:00Z' END AS last_seen,
  CASE WHEN id % 8 = 0 THEN NULL ELSE 50 + (id % 1000) / 125::DOUBLE END AS lat, CASE WHEN id % 12 = 0 THEN NULL ELSE 100 + (id % 900) / 8::DOUBLE END AS lon, CASE id % 4 WHEN 1 THEN (id % 37)::VARCHAR WHEN 2 THEN 'many' END AS hotspot_count,
  CASE WHEN id % 3 = 0 THEN NULL ELSE ((id % 80) / 4::DOUBLE)::VARCHAR END AS frp_max, CASE WHEN source = 'firms' THEN 'firms-cluster-v1' END AS method, CASE WHEN id % 5 = 1 THEN '' ELSE 'N,N20' END AS satellite FROM f)"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Incidents with the columns that an export shows."""
    i, k = V.incidents(spark, d), F.col("id")
    stamp_ = lambda days: F.concat(F.date_format(F.date_add("detected_date", days), "yyyy-MM-dd"), F.lit("T05:12:00Z"))
    lat, lon = F.when(k % 8 != 0, F.lit(50) + (k % 1000) / 125.0), F.when(k % 12 != 0, F.lit(100) + (k % 900) / 8.0)
    return i.withColumns({
        "region_iso": F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("RU-"), (k % 9).cast("string"))), "first_seen": stamp_(0), "last_seen": F.when(k % 5 != 0, stamp_(1)), "center_lat": lat, "center_lng": lon,
        "bbox_min_lat": lat - 0.125, "bbox_min_lng": lon - 0.125, "bbox_max_lat": lat + 0.125, "bbox_max_lng": lon + 0.125, "hotspot_count": F.when(k % 4 == 1, (k % 37).cast("string")).when(k % 4 == 2, "many"),
        "frp_max": F.when(k % 3 != 0, ((k % 80) / 4.0).cast("string")), "method": F.when(F.col("source") == "firms", I.METHOD), "satellite": F.when(k % 5 == 1, "").otherwise("N,N20"),
    })


SITE, AREA_NOTE = "https://fires.example", "upper bound: pixels times their area"
EXPORT_ASK = {"sort": "area_desc", "static_sources": "include", "region": "BUILDING"}


def _licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("firms", "open")], "source string, license string")


@query(f"""WITH {STORED_SQL}
SELECT id, change_type, status, region, nullif(region_iso, '') AS region_iso, strftime(detected_date, '%Y-%m-%d') AS detected_date, first_seen, last_seen, lat AS center_lat, lon AS center_lon, lat - 0.125 AS bbox_min_lat, lon - 0.125 AS bbox_min_lon, lat + 0.125 AS bbox_max_lat, lon + 0.125 AS bbox_max_lon,
  area_ha, CASE WHEN method IS NOT NULL THEN '{AREA_NOTE}' END AS area_note, try_cast(hotspot_count AS DOUBLE) AS hotspot_count, try_cast(frp_max AS DOUBLE) AS frp_max, nullif(satellite, '') AS satellites, severity, confidence, source, method, CASE WHEN source = 'firms' THEN 'open' END AS license,
  CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN '{SITE}/?lat=' || regexp_replace(format('{{:.6f}}', lat), '\\.?0+$', '') || '&lng=' || regexp_replace(format('{{:.6f}}', lon), '\\.?0+$', '') || '&incident=' || id ELSE '{SITE}/incidents?id=' || id END AS url
FROM m WHERE region = 'BUILDING' ORDER BY area_ha DESC NULLS LAST, id DESC LIMIT 5001""")
def incident_export(spark: SparkSession, d: str) -> DataFrame:
    """The 25 columns of an export."""
    return feed.export_rows(feed.export(_stored(spark, d), V.areas(spark, d), EXPORT_ASK), _licenses(spark), SITE, I.METHOD, AREA_NOTE)


@query(f"""WITH {STORED_SQL}, n AS (SELECT count(*) AS n FROM m WHERE region = 'BUILDING')
SELECT 'incidents' AS dataset, 'area_desc' AS sort, least(n, 5000) AS rows, n > 5000 AS too_many, 'firms-cluster-v1' AS method, 'region=BUILDING;static_sources=include' AS filters FROM n""")
def incident_export_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = feed.export(_stored(spark, d), V.areas(spark, d), EXPORT_ASK)
    m = feed.export_metadata(rows, EXPORT_ASK, _licenses(spark), I.method_parameters())
    filters = F.array_join(F.transform(F.array_sort(F.map_entries("filters")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return m.select("dataset", "sort", "rows", "too_many", "method.method", filters.alias("filters"))


@query(f"""WITH {STORED_SQL} SELECT id AS incident_id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon - 0.125 * (id % 2) END AS w, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat - 0.125 * (id % 2) END AS s,
  strftime(detected_date, '%Y-%m-%d') AS first_seen, strftime(CASE WHEN id % 5 = 0 THEN detected_date ELSE detected_date + 1 END, '%Y-%m-%d') AS last_seen, CASE WHEN lat IS NULL OR lon IS NULL THEN 'no geometry' END AS problem FROM m""")
def imagery_geometry(spark: SparkSession, d: str) -> DataFrame:
    s = _stored(spark, d).withColumnRenamed("id", "incident_id")
    s = s.withColumns({c: F.when(F.col("incident_id") % 2 == 1, F.col(c)) for c in ("bbox_min_lat", "bbox_min_lng", "bbox_max_lat", "bbox_max_lng")}).withColumn("first_seen", F.when(F.col("incident_id") % 7 != 0, F.col("first_seen")))
    g = I.imagery_geometry(s)
    return g.select("incident_id", "w", "s", day("first_seen").alias("first_seen"), day("last_seen").alias("last_seen"), "problem")


@query(f"WITH {H_SQL} SELECT count(*) AS n FROM h WHERE confidence IN ('high', 'nominal')")
def active_fire_count(spark: SparkSession, d: str) -> DataFrame:
    return readers.active_fires(V.hotspots(spark, d))

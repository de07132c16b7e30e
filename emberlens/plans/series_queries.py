"""Queries on polygon masks, index comparisons and the yearly vegetation series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlens.functions import spectral as S
from emberlens.operators import raster, series
from emberlens.plans import views as V
from emberlens.plans.picture_queries import utm_sql
from emberlens.plans.views import PIXELS_SQL, jr, query
from emberlens.session import table
from emberlens.shared import materialize, scratch_path
from emberlens.sources import tiff

CORNERS = 5


def _inside(x: str, y: str, key: str, ring: str) -> str:
    """Whether a pixel's centre lies in a ring (key, k, n, x, y): each edge goes from a corner to the one before it."""
    return f"""(SELECT count(*) % 2 = 1 FROM {ring} i JOIN {ring} j ON j.key = i.key AND j.k = (i.k + i.n - 1) % i.n WHERE i.key = {key} AND (i.y > {y}) <> (j.y > {y}) AND {x} < (j.x - i.x) * ({y} - i.y) / (j.y - i.y) + i.x)"""


MASK_SQL = f"""g AS (SELECT p_partkey AS key, 8 + p_partkey % 13 AS width, 6 + p_partkey % 11 AS height FROM part),
c AS (SELECT key, k, {CORNERS} AS n, width, height, ((key * (k * 7 + 3)) % 97) * width / 97::DOUBLE * 1.4::DOUBLE - width * 0.2::DOUBLE AS x, ((key * (k * 11 + 5)) % 89) * height / 89::DOUBLE * 1.4::DOUBLE - height * 0.2::DOUBLE AS y FROM g, range({CORNERS}) r(k)),
ring AS (SELECT key, k, n, CASE WHEN key % 7 = 0 THEN x * 0.01::DOUBLE + width * 0.4::DOUBLE WHEN key % 23 = 0 THEN x + 100 ELSE x END AS x, CASE WHEN key % 7 = 0 THEN y * 0.01::DOUBLE + height * 0.3::DOUBLE ELSE y END AS y FROM c),
e AS (SELECT i.key, i.x AS x1, i.y AS y1, j.x AS x2, j.y AS y2 FROM ring i JOIN ring j ON j.key = i.key AND j.k = (i.k + i.n - 1) % i.n),
px AS (SELECT key, r.v AS row, q.v AS col FROM g, range(height) r(v), range(width) q(v)),
hit AS (SELECT px.key, row, col FROM px JOIN e ON e.key = px.key AND (y1 > row + 0.5) <> (y2 > row + 0.5) AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
mid AS (SELECT g.key, floor(sum(y ORDER BY k) / {CORNERS})::BIGINT AS row, floor(sum(x ORDER BY k) / {CORNERS})::BIGINT AS col, any_value(width) AS width, any_value(height) AS height FROM g JOIN ring USING (key) GROUP BY g.key),
m AS (SELECT key, row, col FROM hit UNION ALL SELECT key, row, col FROM mid WHERE row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1 AND key NOT IN (SELECT key FROM hit))"""


@query(f"WITH {MASK_SQL} SELECT key, row, count(*) AS n, sum(col)::BIGINT AS columns, sum(col * col)::BIGINT AS squares FROM m GROUP BY ALL")
def polygon_masks(spark: SparkSession, d: str) -> DataFrame:
    """Pixels inside five-cornered rings that cross themselves, some too small for a pixel, some off their grid."""
    k = F.col("key")
    g = table(spark, d, "part").select(F.col("p_partkey").alias("key")).withColumns({"width": k % 13 + 8, "height": k % 11 + 6})
    x = lambda i: (k * (i * 7 + 3) % 97) * F.col("width") / F.lit(97.0) * 1.4 - F.col("width") * 0.2
    y = lambda i: (k * (i * 11 + 5) % 89) * F.col("height") / F.lit(89.0) * 1.4 - F.col("height") * 0.2
    small = k % 7 == 0
    corner = lambda i: F.struct(F.when(small, x(i) * 0.01 + F.col("width") * 0.4).when(k % 23 == 0, x(i) + 100).otherwise(x(i)).alias("x"), F.when(small, y(i) * 0.01 + F.col("height") * 0.3).otherwise(y(i)).alias("y"))
    spans = series.mask_spans(g.withColumn("ring", F.array(*[corner(i) for i in range(CORNERS)])), ["key"])
    pixels = series.mask_pixels(spans, ["key"])
    return pixels.groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("col").alias("columns"), F.sum(F.col("col") * F.col("col")).alias("squares"))


SIDES_SQL = f"""{PIXELS_SQL}, r AS (SELECT scene, CASE WHEN scene % 6 = 0 AND l_linenumber < 4 THEN NULL ELSE b4 * 0.0001::DOUBLE - 0.01 END AS red, b8 * 0.0001::DOUBLE - 0.01 AS nir, CASE WHEN b12 <> 0 THEN b12 * 0.0001::DOUBLE - 0.01 END AS swir FROM px),
v AS (SELECT scene, CASE WHEN nir + red > 0 THEN greatest(-1, least(1, (nir - red) / (nir + red))) END AS v, CASE WHEN nir + swir > 0 THEN greatest(-1, least(1, (nir - swir) / (nir + swir))) END AS b FROM r),
s AS (SELECT scene, count(*) AS total, count(*) FILTER (v IS NOT NULL AND b IS NOT NULL) AS valid, avg(v) FILTER (b IS NOT NULL) AS mv, avg(b) FILTER (v IS NOT NULL) AS mb FROM v GROUP BY 1),
x AS (SELECT scene, CASE WHEN valid * 2 >= total THEN {jr('mv', 3)} END AS ndvi, CASE WHEN valid * 2 >= total THEN {jr('mb', 3)} END AS nbr FROM s),
before AS (SELECT CASE WHEN scene = 38 THEN 19 ELSE scene END AS place, * FROM x WHERE scene < 19 OR scene = 38), after AS (SELECT CASE WHEN scene = 39 THEN 20 ELSE scene - 19 END AS place, *, scene % 3 = 0 AS during FROM x WHERE scene BETWEEN 19 AND 37 OR scene = 39),
j AS (SELECT coalesce(b.place, a.place) AS place, b.scene IS NOT NULL AS hb, a.scene IS NOT NULL AS ha, b.ndvi AS nb, a.ndvi AS na, b.nbr AS bb, a.nbr AS ba, coalesce(a.during, false) AND b.nbr IS NOT NULL AND a.nbr IS NOT NULL AS during FROM before b FULL JOIN after a ON a.place = b.place),
d AS (SELECT *, CASE WHEN NOT during THEN {jr('bb - ba', 3)} END AS dnbr FROM j)"""
SEVERITY = "CASE WHEN dnbr IS NOT NULL THEN CASE " + " ".join(f"WHEN dnbr < {bound}::DOUBLE THEN '{name}'" for bound, name in S.CLASSES["severity"][:-1]) + f" ELSE '{S.CLASSES['severity'][-1][1]}' END END"


@query(f"""WITH {SIDES_SQL} SELECT place, {jr('na - nb', 3)} AS dndvi, dnbr, {SEVERITY} AS severity,
  concat_ws(', ', CASE WHEN NOT hb THEN 'before missing' WHEN nb IS NULL THEN 'before cloudy' END, CASE WHEN NOT ha THEN 'after missing' WHEN na IS NULL THEN 'after cloudy' END, CASE WHEN during THEN 'during activity' END) AS reasons FROM d""")
def index_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Scenes in pairs, before and after; some sides are missing, clouded or were taken during the activity."""
    p = V.pixels(spark, d)
    clouded = (F.col("scene") % 6 == 0) & (F.col("l_linenumber") < 4)
    refl = p.select("scene", F.when(~clouded, S.reflectance("b4", 0.0001, -0.01)).alias("red"), S.reflectance("b8", 0.0001, -0.01).alias("nir"), S.reflectance("b12", 0.0001, -0.01).alias("swir2"))
    stats, scene = materialize(raster.index_stats(refl, ["scene"]), "scene-indices"), F.col("scene")
    before = stats.where((scene < 19) | (scene == 38)).withColumn("place", F.when(scene == 38, 19).otherwise(scene))
    after = stats.where(scene.between(19, 37) | (scene == 39)).withColumns({"place": F.when(scene == 39, 20).otherwise(scene - 19), "during_activity": scene % 3 == 0})
    return raster.combine_indices(before, after, ["place"]).select("place", "dndvi", "dnbr", "severity", F.array_join("reasons", ", ").alias("reasons"))


# ---- the series: targets from suppliers, scenes from orders, images of 80 by 80 pixels (a pattern of 20 by 20, repeated) from line items
EPSG, X0, Y0, STEP, TILE, TILES, PIXEL_M = 32648, 420_000.0, 5_900_000.0, 2000.0, 20, 4, 100.0
SERIES_SQL = f"""t AS (SELECT s_suppkey AS key, 104.1::DOUBLE + (s_suppkey % 17) * 0.07::DOUBLE AS w, 52.1::DOUBLE + (s_suppkey % 13) * 0.05::DOUBLE AS s, (s_suppkey % 4) * 0.01::DOUBLE AS dx, (s_suppkey % 3) * 0.01::DOUBLE AS dy FROM supplier),
t1 AS (SELECT key, w, s, w + dx AS e, s + dy AS n, (w + (w + dx)) / 2 AS lon, (s + (s + dy)) / 2 AS lat FROM t),
t2 AS (SELECT *, cos(lat * pi() / 180) * 111.32::DOUBLE AS per, greatest(3, (e - w) * (cos(lat * pi() / 180) * 111.32::DOUBLE) * 1.2::DOUBLE) AS wide, greatest(3, (n - s) * 110.574::DOUBLE * 1.2::DOUBLE) AS high FROM t1),
t3 AS (SELECT *, CASE WHEN greatest(wide, high) > 20 THEN 20 ELSE wide END / 2 / per AS hx, CASE WHEN greatest(wide, high) > 20 THEN 20 ELSE high END / 2 / 110.574::DOUBLE AS hy FROM t2),
ar AS (SELECT key, {jr('lon - hx', 5)} AS aw, {jr('lat - hy', 5)} AS as_, {jr('lon + hx', 5)} AS ae, {jr('lat + hy', 5)} AS an, {jr('w - 0.1875::DOUBLE / per', 5)} AS pw, {jr('s - 0.1875::DOUBLE / 110.574::DOUBLE', 5)} AS ps, {jr('e + 0.1875::DOUBLE / per', 5)} AS pe, {jr('n + 0.1875::DOUBLE / 110.574::DOUBLE', 5)} AS pn FROM t3),
q AS (SELECT key, kind, k, {EPSG} AS epsg, lat, lon FROM (
  SELECT key, 'edge' AS kind, 0 AS k, as_ AS lat, aw + (ae - aw) * (i / 8::DOUBLE) AS lon FROM ar, range(9) r(i) UNION ALL SELECT key, 'edge', 0, an, aw + (ae - aw) * (i / 8::DOUBLE) FROM ar, range(9) r(i)
  UNION ALL SELECT key, 'edge', 0, as_ + (an - as_) * (i / 8::DOUBLE), aw FROM ar, range(9) r(i) UNION ALL SELECT key, 'edge', 0, as_ + (an - as_) * (i / 8::DOUBLE), ae FROM ar, range(9) r(i)
  UNION ALL SELECT key, 'ring', k, [as_, as_, an, an][k + 1], [aw, ae, ae, aw][k + 1] FROM ar, range(4) r(k)
  UNION ALL SELECT key, 'site', k, [greatest(ps, as_), greatest(ps, as_), least(pn, an), least(pn, an)][k + 1], [greatest(pw, aw), least(pe, ae), least(pe, ae), greatest(pw, aw)][k + 1] FROM ar, range(4) r(k))),
{utm_sql('q')},
bx AS (SELECT key, min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM utm WHERE kind = 'edge' GROUP BY key),
gz AS (SELECT *, greatest({PIXEL_M}::DOUBLE, greatest(e - w, n - s) / 512) AS pixel FROM bx),
gr AS (SELECT key, pixel, greatest(1, least(512, ceil((e - w) / pixel - 1e-9::DOUBLE)))::BIGINT AS width, greatest(1, least(512, ceil((n - s) / pixel - 1e-9::DOUBLE)))::BIGINT AS height, (w + e) / 2 AS cx, (s + n) / 2 AS cy FROM gz),
gd AS (SELECT *, cx - width * pixel / 2 AS gw, cy + height * pixel / 2 AS gn FROM gr),
co AS (SELECT u.key, kind, k, (x - gw) / pixel AS x, (gn - y) / pixel AS y FROM utm u JOIN gd USING (key) WHERE kind <> 'edge'),
ed AS (SELECT i.key, i.kind, i.x AS x1, i.y AS y1, j.x AS x2, j.y AS y2 FROM co i JOIN co j ON j.key = i.key AND j.kind = i.kind AND j.k = (i.k + 3) % 4),
gp AS (SELECT key, r.v AS row, c.v AS col, floor((gw + (c.v + 0.5) * pixel - {X0}) / {STEP})::BIGINT AS ic, floor(({Y0} - (gn - (r.v + 0.5) * pixel)) / {STEP})::BIGINT AS ir FROM gd, range(height) r(v), range(width) c(v)),
hit AS (SELECT gp.key, kind, row, col FROM gp JOIN ed ON ed.key = gp.key AND (y1 > row + 0.5) <> (y2 > row + 0.5) AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
mk AS (SELECT key, row, col, CASE WHEN bool_or(kind = 'site') THEN 'site' ELSE 'ring' END AS region FROM hit GROUP BY ALL),
base AS (SELECT l_orderkey % 40 AS img, (l_partkey * 7 + l_linenumber) % {TILE} AS c, (l_suppkey * 3 + l_linenumber) % {TILE} AS r, max(200 + l_quantity * 37) AS red, max(500 + l_quantity * 11 + l_linenumber * 90) AS nir, max(l_quantity) AS top FROM lineitem GROUP BY ALL),
im AS (SELECT img, c, r, red, nir, CASE WHEN (top * 7 + c)::BIGINT % 10 < img % 5 THEN 9 ELSE 4 END AS scl FROM base),
sc AS (SELECT o_orderkey AS scene_id, o_orderkey % 40 AS img, year(o_orderdate)::INT AS year, o_orderdate AS seen, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 31) % 100 END AS cloud, 103.8::DOUBLE + (o_orderkey % 10) * 0.2::DOUBLE AS w, 51.8::DOUBLE + (o_custkey % 8) * 0.15::DOUBLE AS s FROM orders
  WHERE month(o_orderdate) IN (7, 8)),
ca AS (SELECT ar.key, sc.year, sc.scene_id, img, row_number() OVER (PARTITION BY ar.key, sc.year ORDER BY cloud, seen, scene_id) AS rank FROM ar JOIN sc ON w <= ae AND w + 0.6::DOUBLE >= aw AND s <= an AND s + 0.5::DOUBLE >= as_ WHERE cloud < 80 QUALIFY rank <= 6),
rd AS (SELECT ca.key, ca.year, ca.scene_id, rank, gp.row, gp.col, CASE WHEN ic BETWEEN 0 AND {TILE * TILES - 1} AND ir BETWEEN 0 AND {TILE * TILES - 1} THEN coalesce(im.scl, 0) ELSE 0 END AS scl, CASE WHEN ic BETWEEN 0 AND {TILE * TILES - 1} AND ir BETWEEN 0 AND {TILE * TILES - 1} THEN im.red END AS red, CASE WHEN ic BETWEEN 0 AND {TILE * TILES - 1} AND ir BETWEEN 0 AND {TILE * TILES - 1} THEN im.nir END AS nir
  FROM ca JOIN gp ON gp.key = ca.key LEFT JOIN im ON im.img = ca.img AND im.c = ic % {TILE} AND im.r = ir % {TILE}),
us AS (SELECT key, year, scene_id, rank, count(*) FILTER (scl = 4) AS clear, count(*) AS total FROM rd GROUP BY ALL HAVING count(*) FILTER (scl = 4) / count(*) >= 0.8 AND count(*) FILTER (scl = 0) / count(*) <= 0.05),
ch AS (SELECT * FROM us QUALIFY row_number() OVER (PARTITION BY key, year ORDER BY rank) = 1),
vl AS (SELECT rd.key, rd.year, rd.scene_id, region, CASE WHEN scl = 4 AND red + nir > 0 THEN (nir * 0.0001::DOUBLE - 0.01::DOUBLE - (red * 0.0001::DOUBLE - 0.01::DOUBLE)) / (nir * 0.0001::DOUBLE - 0.01::DOUBLE + (red * 0.0001::DOUBLE - 0.01::DOUBLE)) END AS v FROM rd JOIN ch ON ch.key = rd.key AND ch.year = rd.year AND ch.scene_id = rd.scene_id JOIN mk ON mk.key = rd.key AND mk.row = rd.row AND mk.col = rd.col),
mn AS (SELECT key, year, region, CASE WHEN count(v) * 2 >= count(*) THEN {jr('avg(v)', 3)} END AS ndvi, floor(count(v) * 100 / count(*))::BIGINT AS pct FROM vl GROUP BY ALL),
nw AS (SELECT max(o_orderdate) AS t FROM orders),
yr AS (SELECT key, y::INT AS year FROM t, nw, range(1992, CASE WHEN t >= make_timestamp(year(t), 7, 1, 0, 0, 0) THEN year(t) + 1 ELSE year(t) END) r(y))"""


@query(f"""WITH {SERIES_SQL} SELECT yr.key, yr.year, CASE WHEN ch.key IS NOT NULL THEN 'ok' ELSE 'none' END AS status, CASE WHEN ch.key IS NOT NULL THEN NULL WHEN had.key IS NOT NULL THEN 'cloudy' WHEN t < make_timestamp(yr.year, 8, 31, 23, 59, 59.999) THEN 'not yet' ELSE 'no scenes' END AS reason,
  ch.scene_id, floor(ch.clear / ch.total * 100)::BIGINT AS clear_pct, s.ndvi, s.pct AS valid_pct, g.ndvi AS ring_ndvi, g.pct AS ring_valid_pct, t < make_timestamp(yr.year, 8, 31, 23, 59, 59.999) AS partial
FROM yr CROSS JOIN nw LEFT JOIN ch ON ch.key = yr.key AND ch.year = yr.year LEFT JOIN (SELECT DISTINCT key, year FROM ca) had ON had.key = yr.key AND had.year = yr.year
LEFT JOIN mn s ON s.key = yr.key AND s.year = yr.year AND s.region = 'site' LEFT JOIN mn g ON g.key = yr.key AND g.year = yr.year AND g.region = 'ring'""")
def ndvi_series(spark: SparkSession, d: str) -> DataFrame:
    """One row for each target and summer: the least cloudy usable scene, the index of the site and of the ring around it, or why there is none."""
    k, n, q = F.col("s_suppkey"), F.col("l_linenumber"), F.col("l_quantity")
    w, s = F.lit(104.1) + (k % 17) * 0.07, F.lit(52.1) + (k % 13) * 0.05
    targets = table(spark, d, "supplier").select(k.alias("key"), w.alias("w"), s.alias("s"), (w + (k % 4) * 0.01).alias("e"), (s + (k % 3) * 0.01).alias("n"))
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    as_of = F.lit(orders.agg(F.max("at")).first()[0])
    west, south = F.lit(103.8) + (o % 10) * 0.2, F.lit(51.8) + (F.col("o_custkey") % 8) * 0.15
    scenes = orders.select(o.alias("scene_id"), west.alias("w"), south.alias("s"), (west + 0.6).alias("e"), (south + 0.5).alias("n"), F.col("at").alias("acquired_at"), F.when(o % 9 != 0, (o * 31 % 100).cast("double")).alias("cloud_cover"), F.lit(EPSG).alias("epsg"))
    base = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("img"), ((F.col("l_partkey") * 7 + n) % TILE).alias("c"), ((F.col("l_suppkey") * 3 + n) % TILE).alias("r")).agg(
        F.max(q * 37 + 200).cast("double").alias("red"), F.max(q * 11 + 500 + n * 90).cast("double").alias("nir"), F.max("l_quantity").alias("top")
    )
    scl = F.when((F.col("top") * 7 + F.col("c")).cast("long") % 10 < F.col("img") % 5, 9.0).otherwise(4.0)
    tiles = F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))
    bands = F.explode(F.create_map(F.lit("red"), F.col("red"), F.lit("nir"), F.col("nir"), F.lit("scl"), scl)).alias("band", "value")
    spread = base.select("*", tiles.alias("i")).select("*", tiles.alias("j")).select("img", (F.col("i") * TILE + F.col("c")).alias("col"), (F.col("j") * TILE + F.col("r")).alias("row"), bands)
    pixels = materialize(spread.select(F.concat_ws("/", F.col("img").cast("string"), "band").alias("image"), "col", "row", "value"), "image-pixels")
    images = scenes.select("scene_id", F.explode(F.array(F.lit("red"), F.lit("nir"), F.lit("scl"))).alias("band")).select(
        "scene_id", "band", F.concat_ws("/", (F.col("scene_id") % 40).cast("string"), "band").alias("image"), F.lit(X0).alias("x0"), F.lit(Y0).alias("y0"), F.lit(STEP).alias("resolution"),
        F.lit(TILE * TILES).alias("width"), F.lit(TILE * TILES).alias("height"), F.lit(0.0001).alias("scale"), F.lit(-0.01).alias("offset"),
    )
    return series.yearly_series(targets, scenes, images, pixels, as_of, 1992, PIXEL_M)


# ---- windows of rasters in files
IMAGE_WIDE, IMAGE_HIGH = 50, 60


@query(f"""WITH px AS (SELECT 'i' || (l_orderkey % 40) AS image, (l_partkey * 7 + l_linenumber) % {IMAGE_WIDE} AS c, (l_suppkey * 3 + l_linenumber) % {IMAGE_HIGH} AS r, max(l_quantity * 37 + l_linenumber)::BIGINT AS v FROM lineitem GROUP BY ALL),
al AS (SELECT image, 0 AS level, c AS col, r AS row, v FROM px UNION ALL SELECT image, 1, c // 2, r // 2, v FROM px WHERE c % 2 = 0 AND r % 2 = 0),
w AS (SELECT DISTINCT image, level, CASE level WHEN 0 THEN 5 ELSE 0 END AS x0, CASE level WHEN 0 THEN 45 ELSE 20 END AS x1, CASE level WHEN 0 THEN 10 ELSE 25 END AS y0, CASE level WHEN 0 THEN 52 ELSE 30 END AS y1 FROM px, (VALUES (0), (1)) l(level))
SELECT w.image, w.level, any_value((x1 - x0) * (y1 - y0))::BIGINT AS n, coalesce(sum(v), 0)::BIGINT AS total, coalesce(sum(v * (al.col + 1) * (al.row + 1)), 0)::BIGINT AS weighted
FROM w LEFT JOIN al ON al.image = w.image AND al.level = w.level AND al.col >= x0 AND al.col < x1 AND al.row >= y0 AND al.row < y1 GROUP BY w.image, w.level""")
def raster_windows(spark: SparkSession, d: str) -> DataFrame:
    """Images with an overview, written as tiled files by tasks, and a window of each level of each read by ranges."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    cells = table(spark, d, "lineitem").groupBy(F.concat(F.lit("i"), (k % 40).cast("string")).alias("image"), ((F.col("l_partkey") * 7 + n) % IMAGE_WIDE).alias("c"), ((F.col("l_suppkey") * 3 + n) % IMAGE_HIGH).alias("r")).agg(F.max(F.col("l_quantity") * 37 + n).cast("int").alias("v"))
    folder = scratch_path(spark, "images")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:  # an image has as many rows as pixels at most
        grid = np.zeros((IMAGE_HIGH, IMAGE_WIDE), "u2")
        grid[pdf["r"], pdf["c"]] = pdf["v"]
        name = pdf["image"].iloc[0]
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}.tif") as f:
            f.write(tiff.encode([grid, grid[::2, ::2].copy()], 16))
        return pd.DataFrame({"image": pd.Series([name], dtype=object), "path": pd.Series([f"{folder}/{name}.tif"], dtype=object)})

    written = materialize(cells.groupBy("image").applyInPandas(write, "image string, path string"), "image-files")
    box = lambda level, *sides: F.struct(F.lit(level).alias("level"), *[F.lit(v).cast("long").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), sides, strict=True)])
    windows = written.select("image", "path", F.explode(F.array(box(0, 5, 10, 45, 52), box(1, -3, 25, 20, 999))).alias("w")).select("image", "path", "w.*")
    out = tiff.read_windows(windows).groupBy("image", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("total"), F.sum(F.col("value") * (F.col("col") + 1) * (F.col("row") + 1)).cast("long").alias("weighted"))
    return out

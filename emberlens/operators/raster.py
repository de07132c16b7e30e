"""Rasters as rows of pixels: statistics of a scene's mask, index means of a region, the best scenes, projected boxes, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.functions import numeric as N, projection as P, spectral as S

CLEAR_LEAST, NODATA_MOST, VALID_LEAST, SNOW_LEAST = 0.8, 0.05, 0.5, 0.2
CANDIDATES = 6
#: Samples of a box's edge, less one.
EDGE_STEPS = 8


def scl_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scl) -> counts of each kind of pixel and their shares."""
    c = F.col("scl")
    kinds = {"clear": S.is_clear(c), "nodata": c == S.NODATA_SCL, "cloud": c.isin(*S.CLOUD_SCL), "shadow": c == S.SHADOW_SCL, "snow": c == S.SNOW_SCL, "saturated": c == S.SATURATED_SCL}
    out = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v).alias(k) for k, v in kinds.items()])
    return out.withColumn("usable", is_usable())


def is_usable() -> Column:
    """Enough clear pixels, few without data."""
    return (F.col("clear") / F.col("total") >= CLEAR_LEAST) & (F.col("nodata") / F.col("total") <= NODATA_MOST)


def is_covered() -> Column:
    """Few pixels without data: the scene shows the place, whatever it shows of it."""
    return F.col("total").isNotNull() & (F.coalesce(F.col("nodata") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)) <= NODATA_MOST)


def mostly_snow() -> Column:
    """Over the scenes that were looked at: in most of the covered ones snow has a fifth of the pixels and outweighs clouds and shadows. An aggregate."""
    snowy = (F.coalesce(F.col("snow") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)) >= SNOW_LEAST) & (F.col("snow") >= F.col("cloud") + F.col("shadow"))
    return F.count_if(is_covered() & snowy) * 2 > F.count_if(is_covered())


def index_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, red, nir, swir2 as reflectance, null for no data) -> total, valid, valid_pct (whole percent), mean ndvi and nbr, null under half valid."""
    ndvi, nbr = S.normalized_difference("nir", "red"), S.normalized_difference("nir", "swir2")
    ok = ndvi.isNotNull() & nbr.isNotNull()
    out = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.avg(F.when(ok, ndvi)).alias("n"), F.avg(F.when(ok, nbr)).alias("b"))
    enough = F.col("valid") >= F.col("total") * VALID_LEAST
    return out.select(*keys, "total", "valid", F.floor(F.col("valid") * 100 / F.col("total")).cast("long").alias("valid_pct"), F.when(enough, N.js_round("n", 3)).alias("ndvi"), F.when(enough, N.js_round("b", 3)).alias("nbr"))


def combine_indices(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Index means before and after (keys, ndvi, nbr, valid_pct; after may have during_activity) -> their differences, the burn severity, and why values are missing.

    A side without a row has no scene. reasons: 'before missing', 'before cloudy' (too few clear pixels), the same for after, and 'during activity': smoke and
    fire distort the ratio, so neither dnbr nor severity is given when the picture after was taken meanwhile."""
    during = F.col("during_activity") if "during_activity" in after.columns else F.lit(False)
    side = lambda df, name, *more: df.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in ("ndvi", "nbr")], F.lit(True).alias(f"has_{name}"), *more)
    j = side(before, "before").join(side(after, "after", F.coalesce(during, F.lit(False)).alias("during")), keys, "outer")
    during = F.coalesce("during", F.lit(False)) & F.col("nbr_before").isNotNull() & F.col("nbr_after").isNotNull()
    d = F.when(~during, N.js_round(F.col("nbr_before") - F.col("nbr_after"), 3))
    why = [F.when(F.col(f"has_{n}").isNull(), f"{n} missing").when(F.col(f"ndvi_{n}").isNull(), f"{n} cloudy") for n in ("before", "after")]
    reasons = F.filter(F.array(*why, F.when(during, "during activity")), lambda r: r.isNotNull())
    out = j.withColumns({"dndvi": N.js_round(F.col("ndvi_after") - F.col("ndvi_before"), 3), "dnbr": d, "severity": S.severity(d), "reasons": reasons})
    return out.drop("has_before", "has_after", "during")


def mask_pixels(pixels: DataFrame, inside: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Pixels (id, ...) of a mask's ids, less those of a second mask."""
    out = pixels.join(inside.select("id"), "id", "left_semi")
    return out if without is None else out.join(without.select("id"), "id", "left_anti")


def candidates(scenes: DataFrame, keys: list[str], most: int = CANDIDATES) -> DataFrame:
    """Scenes by cloud cover (null as 100), then time and id; the first ``most`` of each key are looked at (that number is the feature)."""
    order = W.partitionBy(*keys).orderBy(F.coalesce("cloud_cover", F.lit(100.0)), "acquired_at", "scene_id")
    return scenes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def ordered_candidates(scenes: DataFrame, keys: list[str], newest_first: bool = False, most: int = CANDIDATES) -> DataFrame:
    """Scenes by time, those of one acquisition (no more than a minute after one another) by cloud cover; repeated ids once; the first ``most`` of each key, ranked from 1."""
    once = scenes.groupBy(*keys, "scene_id").agg(F.min_by(F.struct(*[c for c in scenes.columns if c not in (*keys, "scene_id")]), "acquired_at").alias("kept")).select(*keys, "scene_id", "kept.*")
    in_time = W.partitionBy(*keys).orderBy("acquired_at", "scene_id")
    apart = F.unix_millis("acquired_at") - F.unix_millis(F.lag("acquired_at").over(in_time)) > 60_000
    dealt = once.withColumn("acquisition", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(in_time))
    way = F.col("acquisition").desc() if newest_first else F.col("acquisition").asc()
    order = W.partitionBy(*keys).orderBy(way, F.coalesce("cloud_cover", F.lit(100.0)), "acquired_at", "scene_id")
    return dealt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("acquisition")


def pick_scene(asked: DataFrame, ranked: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ranked candidates and the statistics of their masks -> (keys, scene_id, checked, reason), a row for each key.

    Candidates are looked at by rank until one is usable. Without one, the reason is 'missing' where there was no candidate, else 'snow' when
    that is what mostly spoils those looked at, else 'cloudy'. A candidate without statistics was looked at and shows nothing.
    """
    j = ranked.select(*keys, "scene_id", "rank").join(stats, "scene_id", "left")
    first = j.where("usable").groupBy(*keys).agg(F.min_by("scene_id", "rank").alias("best"), F.min("rank").alias("best_rank"))
    looked = j.join(first, keys, "left").where(F.col("best_rank").isNull() | (F.col("rank") <= F.col("best_rank")))
    seen = looked.groupBy(*keys).agg(F.first("best").alias("scene_id"), F.count(F.lit(1)).alias("checked"), mostly_snow().alias("snowy"))
    out = asked.select(*keys).distinct().join(seen, keys, "left")
    reason = F.when(F.col("scene_id").isNotNull(), F.lit(None)).when(F.col("checked").isNull(), "missing").when(F.col("snowy"), "snow").otherwise("cloudy")
    return out.select(*keys, "scene_id", F.coalesce("checked", F.lit(0)).alias("checked"), reason.alias("reason"))


def best_scene(scenes: DataFrame, stats: DataFrame, keys: list[str], most: int = CANDIDATES) -> DataFrame:
    """(keys, scene_id, checked): the first usable candidate, null when none is, and how many were looked at."""
    j = candidates(scenes, keys, most).join(stats.select("scene_id", "usable"), "scene_id", "left")
    first = F.min(F.when(F.col("usable"), F.struct("rank", "scene_id")))
    out = j.groupBy(*keys).agg(first.alias("best"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("best.scene_id").alias("scene_id"), F.coalesce("best.rank", F.col("n")).cast("long").alias("checked"))


def search_scenes(scenes: DataFrame, box: dict[str, float], start, end, cloud_below: float = 80.0, limit: int = CANDIDATES, order: str = "asc", by_cloud: bool = False) -> DataFrame:
    """Scenes whose footprint meets a box, taken from start to end, with a known cloud cover under the bound: by time ('asc' or 'desc'), or the
    clearest first and then by time. The number of results is the feature; equal ones by scene_id."""
    own = {k: F.col(k) for k in ("w", "s", "e", "n")}
    hit = scenes.where(N.bboxes_meet(own, {k: F.lit(float(v)) for k, v in box.items()})).where(F.col("acquired_at").between(start, end)).where(F.col("cloud_cover") < cloud_below)
    time = F.col("acquired_at").desc() if order == "desc" else F.col("acquired_at").asc()
    return hit.orderBy(*([F.col("cloud_cover"), time] if by_cloud else [time]), "scene_id").limit(limit)


def scene_by_id(scenes: DataFrame, scene_id) -> DataFrame:
    """The scene of an id, of repeated ones the newest; no row where there is none."""
    own = scenes.where(F.col("scene_id") == scene_id)
    return own.groupBy("scene_id").agg(F.max_by(F.struct(*scenes.columns), "acquired_at").alias("s")).select("s.*")


def project_boxes(boxes: DataFrame, keys: list[str], epsg, steps: int = EDGE_STEPS) -> DataFrame:
    """(keys, w, s, e, n in degrees) -> keys, box (struct in metres): the envelope in a zone, each edge sampled ``steps`` times as it curves there.

    Samples become rows, so that each is projected once; they combine before the shuffle. Null boxes and codes that are no zone give a null box.
    """
    w, s, e, n = map(F.col, "wsen")
    points = []
    for i in range(steps + 1):
        lon, lat = w + (e - w) * (i / steps), s + (n - s) * (i / steps)
        points += [F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((lon, s), (lon, n), (w, lat), (e, lat))]
    p = boxes.select(*keys, N.num(epsg).alias("_epsg"), F.explode(F.array(*points)).alias("_p")).select(*keys, P.utm("_p.lat", "_p.lon", "_epsg").alias("_m"))
    out = p.groupBy(*keys).agg(*[f(f"_m.{c}").alias(f"_{k}") for k, f, c in (("w", F.min, "x"), ("s", F.min, "y"), ("e", F.max, "x"), ("n", F.max, "y"))])
    return out.select(*keys, F.when(F.col("_w").isNotNull(), F.struct(*[F.col(f"_{k}").alias(k) for k in "wsen"])).alias("box"))


def resample(pixels: DataFrame, plans: DataFrame, bilinear: bool = False) -> DataFrame:
    """Pixels of images onto output grids: (image, col, row, value), a row for each grid pixel, 0 where there is no data.

    ``pixels``: (image, col, row, value), absent and 0 meaning no data. ``plans``: (image, grid, x0, y0, resolution, window) as made by ``functions.projection``.
    Nearest, or bilinear between the window's pixels; next to one without data bilinear takes the nearest. Grid pixels meet image pixels in an
    equi-join, each with the one or four that it needs.
    """
    g, w = F.col("grid"), F.col("window")
    cells = plans.select("image", "grid", "x0", "y0", "resolution", "window", F.explode(F.sequence(F.lit(0), g["height"] - 1)).alias("row"))
    cells = cells.withColumn("col", F.explode(F.sequence(F.lit(0), g["width"] - 1)))
    x, y = g["w"] + (F.col("col") + 0.5) * g["pixel"], g["n"] - (F.col("row") + 0.5) * g["pixel"]
    fx, fy = (x - F.col("x0")) / F.col("resolution") - w["x0"] - 0.5, (F.col("y0") - y) / F.col("resolution") - w["y0"] - 0.5
    cells = cells.select("image", "col", "row", fx.alias("fx"), fy.alias("fy"), (w["x1"] - w["x0"]).alias("wide"), (w["y1"] - w["y0"]).alias("high"), w["x0"].alias("left"), w["y0"].alias("top"))
    near_x, near_y = F.floor(F.col("fx") + 0.5), F.floor(F.col("fy") + 0.5)
    inside = (near_x >= 0) & (near_y >= 0) & (near_x < F.col("wide")) & (near_y < F.col("high"))
    clip = lambda v, most: F.greatest(F.lit(0), F.least(most - 1, v))
    one = lambda c, r, weight, role: F.struct((c + F.col("left")).cast("long").alias("c"), (r + F.col("top")).cast("long").alias("r"), weight.alias("weight"), F.lit(role).alias("role"))
    asked = [one(near_x, near_y, F.lit(0.0), "nearest")]
    if bilinear:
        left, top = clip(F.floor("fx"), F.col("wide")), clip(F.floor("fy"), F.col("high"))
        right, bottom = F.least(F.col("wide") - 1, left + 1), F.least(F.col("high") - 1, top + 1)
        tx, ty = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f) - at)) for f, at in (("fx", left), ("fy", top)))
        asked += [one(c, r, a * b, "corner") for c, a in ((left, 1 - tx), (right, tx)) for r, b in ((top, 1 - ty), (bottom, ty))]
    wanted = cells.withColumn("p", F.explode(F.when(inside, F.array(*asked)).otherwise(F.array(one(F.lit(-1), F.lit(-1), F.lit(0.0), "nearest")))))
    source = pixels.select(F.col("image").alias("_i"), F.col("col").alias("_c"), F.col("row").alias("_r"), F.col("value").cast("double").alias("value"))
    met = wanted.join(source, (F.col("image") == F.col("_i")) & (F.col("p.c") == F.col("_c")) & (F.col("p.r") == F.col("_r")), "left")
    value = F.coalesce("value", F.lit(0.0))
    corner = F.col("p.role") == "corner"
    out = met.groupBy("image", "col", "row").agg(
        F.max(F.when(~corner, value)).alias("nearest"), F.sum(F.when(corner, value * F.col("p.weight"))).alias("mean"), F.coalesce(F.bool_or(F.when(corner, value == 0)), F.lit(True)).alias("gap")
    )
    return out.select("image", "col", "row", F.when(F.col("gap") | (F.col("nearest") == 0), F.col("nearest")).otherwise(F.col("mean")).alias("value"))

"""Vegetation over the years: polygon masks on picture grids, scenes joined to targets in space and time, candidates read one after another, means under masks.

A target is a box of degrees (an incident's). Its area is the box grown, its site the box and half a detection's pixel around it, its ring what of the area isn't site.
Images are rows of pixels (image, col, row, value), 0 or absent where there is no data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.functions import numeric as N, periods, projection as P, spectral as S
from emberlens.operators import raster, spatial
from emberlens.shared import materialize, whole_side

# Pixels of the index grid, half a detection's pixel, and the cloud cover under which scenes are asked for.
INDEX_PIXEL_M, SITE_PAD_KM, CLOUD_BELOW = 20.0, N.PIXEL_KM / 2, 80.0
BOX = "wsen"


def areas_of(targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w, s, e, n) -> keys, aoi and site (structs of w, s, e, n)."""
    aoi = dict(zip(BOX, (N.js_round(c, 5) for c in N.expand_aoi(*BOX)), strict=True))
    pad = dict(zip(BOX, N.pad_bbox(*BOX, SITE_PAD_KM), strict=True))
    site = N.clip_bbox(pad, aoi)
    return targets.select(*keys, F.struct(*[aoi[k].alias(k) for k in BOX]).alias("aoi"), F.struct(*[site[k].alias(k) for k in BOX]).alias("site"))


def plan_grids(areas: DataFrame, keys: list[str], pixel_m: float = INDEX_PIXEL_M) -> DataFrame:
    """(keys, epsg, aoi, site) -> also grid, and aoi_ring and site_ring: their corners on the grid (structs x, y in fractions of pixels). Areas that no zone has are left out."""
    boxes = raster.project_boxes(areas.select(*keys, "epsg", *[F.col(f"aoi.{k}").alias(k) for k in BOX]), [*keys, "epsg"], "epsg").where("box IS NOT NULL")
    grids = areas.join(whole_side(boxes.select(*keys, "epsg", P.plan_grid(F.col("box"), least_m=pixel_m).alias("grid"))), [*keys, "epsg"])

    def corners(b: str) -> Column:
        ends = [(f"{b}.w", f"{b}.s"), (f"{b}.e", f"{b}.s"), (f"{b}.e", f"{b}.n"), (f"{b}.w", f"{b}.n")]
        return F.array(*[F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")) for lon, lat in ends])

    on_grid = lambda c: F.transform(c, lambda p: P.grid_pixel(p["x"], p["y"], F.col("grid")))
    projected = lambda b: F.transform(corners(b), lambda p: P.utm(p["lat"], p["lon"], F.col("epsg")))
    out = grids.withColumns({"aoi_m": projected("aoi"), "site_m": projected("site")})
    ring = lambda c: F.transform(on_grid(F.col(c)), lambda g: F.struct(g["col"].alias("x"), g["row"].alias("y")))
    return out.select(*areas.columns, "grid", ring("aoi_m").alias("aoi_ring"), ring("site_m").alias("site_ring"))


def mask_spans(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring array<struct<x, y>> in grid pixels, width, height) -> keys, row, first, last: the pixels of each row whose centres lie inside.

    A scan line through the centres of each row crosses the ring's edges; between the first and second crossing, the third and fourth, and so on, pixels are inside. So the work
    grows with edges x rows, not with the pixels of the grid. A ring that holds no centre marks the pixel with the mean of its corners, if that is on the grid.
    """
    n = F.size("ring")
    edges = F.zip_with("ring", F.concat(F.slice("ring", n, F.lit(1)), F.slice("ring", F.lit(1), n - 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    e = shapes.where(n > 0).select(*keys, "width", "height", F.explode(edges).alias("e")).select(*keys, "width", "height", "e.*")
    low, high = F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1
    e = e.withColumns({"low": F.greatest(F.lit(0), low), "high": F.least(F.col("height") - 1, high)}).where("low <= high")
    hit = e.withColumn("row", F.explode(F.sequence("low", "high")))
    x = (F.col("x2") - F.col("x1")) * (F.col("row") + 0.5 - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    order = W.partitionBy(*keys, "row").orderBy("x")
    spans = hit.withColumn("x", x).select(*keys, "row", "width", "x", F.lead("x").over(order).alias("next"), F.row_number().over(order).alias("n")).where("n % 2 = 1 AND next IS NOT NULL")
    first, last = F.greatest(F.lit(0), F.ceil(F.col("x") - 0.5)), F.least(F.col("width") - 1, F.ceil(F.col("next") - 0.5) - 1)
    spans = spans.select(*keys, F.col("row").cast("long"), first.cast("long").alias("first"), last.cast("long").alias("last")).where("first <= last")
    mean = lambda c: F.floor(F.aggregate(F.transform("ring", lambda p: p[c]), F.lit(0.0), lambda a, b: a + b) / F.nullif(n, F.lit(0)))
    centre = shapes.where(n > 0).select(*keys, "width", "height", mean("y").cast("long").alias("row"), mean("x").cast("long").alias("first"))
    centre = centre.where("row >= 0 AND first >= 0 AND row < height AND first < width").select(*keys, "row", "first", F.col("first").alias("last"))
    return spans.union(centre.join(whole_side(spans.select(*keys).distinct()), keys, "left_anti"))


def mask_pixels(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans -> keys, row, col, each pixel once. Rows are dealt out before spans become pixels: by the size of the spans alone, few tasks would get all of them."""
    dealt = spans.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "row")
    return dealt.select(*keys, "row", F.explode(F.sequence("first", "last")).alias("col")).distinct()


def region_masks(plans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, aoi_ring, site_ring) -> keys, row, col, region: the pixels of the site, and of the ring: the area without the site."""
    of = lambda c: mask_pixels(mask_spans(plans.select(*keys, F.col(c).alias("ring"), "grid.width", "grid.height"), keys), keys)
    both = of("site_ring").withColumn("site", F.lit(True)).union(of("aoi_ring").withColumn("site", F.lit(False)))
    return both.groupBy(*keys, "row", "col").agg(F.when(F.bool_or("site"), "site").otherwise("ring").alias("region"))


def read_band(plans: DataFrame, images: DataFrame, pixels: DataFrame, band: str, keys: list[str], only: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, scene_id, grid) -> keys, row, col, value (0: no data) and ``more`` columns of the images: a band of the scene on the grid by nearest neighbour; of ``only`` (keys, row, col, ...)
    where that is given, whose other columns go along.

    ``images``: (scene_id, band, image, x0, y0, resolution, width, height, scale, offset). A grid pixel asks for one image pixel, an equi-join."""
    i = images.where(F.col("band") == band).select("scene_id", "image", "x0", "y0", "resolution", F.col("width").alias("wide"), F.col("height").alias("high"), *more)
    p = plans.select(*keys, *([] if "scene_id" in keys else ["scene_id"]), "grid").join(whole_side(i), "scene_id")
    if only is None:
        cells = p.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid.height").cast("long") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid.width").cast("long") - 1)))
    else:
        cells = only.join(whole_side(p), keys)
        more = (*more, *[c for c in only.columns if c not in (*keys, "row", "col")])
    g = F.col("grid")
    x, y = g["w"] + (F.col("col") + 0.5) * g["pixel"], g["n"] - (F.col("row") + 0.5) * g["pixel"]
    at = cells.select(*keys, "row", "col", "image", "wide", "high", *more, F.floor((x - F.col("x0")) / F.col("resolution")).alias("c"), F.floor((F.col("y0") - y) / F.col("resolution")).alias("r"))
    held = pixels.select("image", F.col("col").cast("long").alias("c"), F.col("row").cast("long").alias("r"), F.col("value").cast("double").alias("value"))
    inside = (F.col("c") >= 0) & (F.col("r") >= 0) & (F.col("c") < F.col("wide")) & (F.col("r") < F.col("high"))
    met = at.join(whole_side(held), ["image", "c", "r"], "left")
    return met.select(*keys, "row", "col", F.when(inside, F.coalesce("value", F.lit(0.0))).otherwise(F.lit(0.0)).alias("value"), *more)


def find_scenes(targets: DataFrame, scenes: DataFrame, as_of: Column, first_year: int = periods.FIRST_YEAR, size: float = 1.0, most: int | None = None) -> DataFrame:
    """Targets (key, aoi, ...) x scenes (scene_id, w, s, e, n, acquired_at, cloud_cover, ...) -> key, year and the scenes' columns: scenes of each summer that meet the area, with a known
    cloud cover below the bound. They meet in cells of a degree grid that both boxes touch.

    With ``most``, scenes of one summer that show exactly the same box are cut to the first ``most`` in the order of ``raster.candidates``: what comes after them is no target's
    first ``most`` either, as all of them meet the same targets."""
    t = targets.select("key", "aoi", F.explode(spatial._box_cells("aoi.w", "aoi.s", "aoi.e", "aoi.n", size)).alias("cell"))
    year = F.year("acquired_at")
    summer = periods.search_window(year, as_of)
    s = scenes.where((year >= first_year) & F.col("acquired_at").between(summer["start"], summer["end"]) & (F.col("cloud_cover") < CLOUD_BELOW))
    s = s.withColumn("year", year)
    if most is not None:
        once = s.groupBy(*BOX, "year", "scene_id").agg(*[F.first(c).alias(c) for c in scenes.columns if c not in (*BOX, "scene_id")])
        s = raster.candidates(once, [*BOX, "year"], most).drop("rank")
    s = s.withColumn("cell", F.explode(spatial._box_cells(*BOX, size)))
    met = t.join(whole_side(s), "cell").where(N.bboxes_meet({k: F.col(k) for k in BOX}, {k: F.col(f"aoi.{k}") for k in BOX}))
    kept = [c for c in scenes.columns if c not in BOX]
    return met.groupBy("key", "year", "scene_id").agg(*[F.first(c).alias(c) for c in kept if c != "scene_id"]).select("key", "year", *kept)


def yearly_series(targets: DataFrame, scenes: DataFrame, images: DataFrame, pixels: DataFrame, as_of: Column, first_year: int = periods.FIRST_YEAR, pixel_m: float = INDEX_PIXEL_M) -> DataFrame:
    """Targets (key, w, s, e, n) -> key, year, status, reason, scene_id, clear_pct, ndvi, valid_pct, ring_ndvi, ring_valid_pct, partial: a row for each target and each year whose summer has begun.

    Scenes of a summer are looked at from the least cloudy on (equal ones by time, then id), six at most; that number is the feature. A scene's mask is read only where those
    before it weren't usable, its bands only where it is. status 'ok', or 'none' with reason 'no scenes', 'not yet' (the summer goes on), or 'cloudy'. Means are
    null where fewer than half of a region's pixels are clear. Targets without a box have no scenes; repeated keys are expected to be one target.
    Targets with the same box are worked out once, their grids and masks once for all scenes of a zone.
    """
    named = targets.select("key", *BOX).distinct()
    sites = materialize(named.groupBy(*BOX).agg(F.min("key").alias("site")), "sites")
    areas = materialize(areas_of(sites.withColumnRenamed("site", "key"), ["key"]), "areas")
    keys = ["key", "year", "scene_id"]
    found = find_scenes(areas, scenes.select("scene_id", *BOX, "acquired_at", "cloud_cover", "epsg"), as_of, first_year, most=raster.CANDIDATES)
    ranked = materialize(raster.candidates(found, ["key", "year"]).join(whole_side(areas), "key").select(*keys, "rank", "epsg", "aoi", "site"), "candidates")
    images = materialize(images.join(whole_side(ranked.select("scene_id").distinct()), "scene_id", "left_semi"), "images")
    grids = materialize(plan_grids(ranked.select("key", "epsg", "aoi", "site").distinct(), ["key"], pixel_m), "grids")
    planned = materialize(ranked.select(*keys, "rank", "epsg").join(whole_side(grids.select("key", "epsg", "grid")), ["key", "epsg"]), "planned")
    left, chosen = ranked.select("key", "year").distinct(), []
    for rank in range(1, raster.CANDIDATES + 1):
        now = materialize(planned.where(F.col("rank") == rank).join(whole_side(left), ["key", "year"], "left_semi"), "plans")
        scl = materialize(read_band(now, images, pixels, "scl", keys).withColumnRenamed("value", "scl"), "scl")
        usable = raster.scl_stats(scl, keys).where("usable").select(*keys, F.floor(F.col("clear") / F.col("total") * 100).cast("long").alias("clear_pct"))
        usable = materialize(usable, "usable")
        chosen.append((now.join(whole_side(usable), keys), materialize(scl.join(whole_side(usable.select(*keys)), keys, "left_semi"), "kept")))
        left = materialize(left.join(whole_side(usable.select("key", "year")), ["key", "year"], "left_anti"), "left")
        if not left.limit(1).count():
            break
    plans, scl = materialize(reduce(DataFrame.union, [p for p, _ in chosen]), "chosen"), reduce(DataFrame.union, [x for _, x in chosen])
    masks = materialize(region_masks(grids.join(whole_side(plans.select("key", "epsg").distinct()), ["key", "epsg"], "left_semi"), ["key", "epsg"]), "masks")
    masks = plans.select(*keys, "epsg").join(whole_side(masks), ["key", "epsg"]).drop("epsg")
    cells = materialize(masks.join(whole_side(scl), [*keys, "row", "col"]), "cells")
    for band in ("red", "nir"):
        cells = read_band(plans, images, pixels, band, keys, cells, ("scale", "offset")).withColumn(band, S.reflectance("value", F.col("scale"), F.col("offset"))).drop("value", "scale", "offset")
    means = cells.groupBy(*keys, "region").agg(*_means())
    regions = means.groupBy(*keys).agg(*[F.max(F.when(F.col("region") == r, F.col(c))).alias(f"{p}{c}") for r, p in (("site", ""), ("ring", "ring_")) for c in ("ndvi", "valid_pct")])
    regions = materialize(regions, "regions")
    done = plans.select(*keys, "clear_pct").join(whole_side(regions), keys, "left")
    years = named.join(whole_side(sites), list(BOX), "left").select("key", "site").withColumn("year", F.explode(periods.series_years(as_of, first_year)))
    had = ranked.select(F.col("key").alias("site"), "year", F.lit(True).alias("had")).distinct()
    out = years.join(whole_side(done.withColumnRenamed("key", "site")), ["site", "year"], "left").join(whole_side(had), ["site", "year"], "left")
    partial = periods.is_partial(F.col("year"), as_of)
    reason = F.when(F.col("scene_id").isNotNull(), F.lit(None)).when(F.col("had"), "cloudy").when(partial, "not yet").otherwise("no scenes")
    return out.select("key", "year", F.when(F.col("scene_id").isNotNull(), "ok").otherwise("none").alias("status"), reason.alias("reason"), "scene_id", "clear_pct", "ndvi", "valid_pct", "ring_ndvi", "ring_valid_pct", partial.alias("partial"))


def _means() -> list[Column]:
    """Over pixels (scl, red, nir as reflectance): the mean NDVI of the clear ones with data, and their share in whole percent."""
    value = F.when(S.is_clear("scl"), S.normalized_difference("nir", "red"))
    enough = F.count(value) >= F.count(F.lit(1)) * raster.VALID_LEAST
    return [F.when(enough, N.js_round(F.avg(value), 3)).alias("ndvi"), F.floor(F.count(value) * 100 / F.count(F.lit(1))).cast("long").alias("valid_pct")]

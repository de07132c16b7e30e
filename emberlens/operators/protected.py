"""Protected areas from a map answer to features: rings from ways, gates before and after thinning out, label points, territory, and a verdict against the last good list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberlens.functions import numeric as N, territory, text as T
from emberlens.operators import geometry, spatial, status
from emberlens.shared import materialize

ANSWER = "elements array<struct<type: string, id: long, tags: map<string, string>, members: array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>>>, remark string"
MEMBERS = "id long, tags map<string,string>, members array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>"


def answer_problem(body: Column) -> Column:
    """Why a map answer (its body as text) can't be used; null when it can: it has elements, and no remark of an error, which stands under partial answers."""
    parsed = F.from_json(body, ANSWER)
    remark = parsed["remark"]
    whole = F.try_parse_json(body).isNotNull() & F.trim(body).startswith("{")
    return (
        F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty")
        .when(T.looks_like_markup(body), "a page instead of data")
        .when(~whole, "no whole object")
        .when(parsed["elements"].isNull(), "no elements")
        .when(F.coalesce(remark.rlike("(?i)error"), F.lit(False)), "partial, with an error")
    )


def relations(answers: DataFrame, column: str = "value") -> DataFrame:
    """Usable answers -> id, tags, members of their relations. Elements of other kinds, and without tags or members, are left out."""
    e = answers.where(answer_problem(F.col(column)).isNull()).select(F.explode(F.from_json(column, ANSWER)["elements"]).alias("e")).select("e.*")
    return e.where("type = 'relation' AND tags IS NOT NULL AND members IS NOT NULL").select("id", "tags", "members")


def shapes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, members) -> rings (id, polygon, ring, points) and points (id, lat, lon): a relation whose ways close no ring is a point, the mean of all its ways' points; one without any has neither."""
    ways = rows.select("id", F.posexplode("members").alias("ord", "m")).where("m.type = 'way' AND size(m.geometry) > 0")
    line = F.transform("m.geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    ways = ways.select(F.col("id").alias("relation"), "ord", F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"), line.alias("points"))
    ways = materialize(ways, "ways")
    rings = materialize(geometry.assemble_rings(ways.where(F.size("points") > 1)).withColumnRenamed("relation", "id"), "rings")
    loose = ways.join(rings.select(F.col("id").alias("relation")).distinct(), "relation", "left_anti").select("relation", F.explode("points").alias("p"))
    return rings, loose.groupBy(F.col("relation").alias("id")).agg(F.avg("p.lat").alias("lat"), F.avg("p.lon").alias("lon"))


def ring_edges(rings: DataFrame) -> DataFrame:
    """Rings (id, polygon, ring, points) as an edge table whose region is the id."""
    n = F.size("points") - 1
    ends = F.zip_with(F.slice("points", F.lit(1), n), F.slice("points", F.lit(2), n), lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))
    return rings.where(n > 0).select(F.col("id").alias("region"), F.lit(0).alias("ord"), "polygon", "ring", (F.col("ring") > 0).alias("hole"), F.explode(ends).alias("e")).select("region", "ord", "polygon", "ring", "hole", "e.*")


def measured(rings: DataFrame) -> DataFrame:
    """Rings -> id, km2, problem: of several the least by name; 'zero area' where nothing else is wrong."""
    km2 = geometry.area_km2(ring_edges(rings)).withColumnRenamed("region", "id")
    wrong = rings.groupBy("id").agg(F.min(geometry.ring_problem(F.col("points"))).alias("wrong"))
    area = F.coalesce(F.col("km2") > 0, F.lit(False))
    return wrong.join(km2, "id", "left").select("id", "km2", F.coalesce("wrong", F.when(~area, "zero area")).alias("problem"))


def features(rows: DataFrame, regions: DataFrame, most: int = geometry.MOST_VERTICES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations (id, tags, members) and the regions' edges -> features, their rings, and problems (id, problem).

    A feature has a shape that passes the gate (points on the globe, closed rings, area above 0) before and after thinning out, a label point inside it that lies in one of
    the regions, and is likely the country's by place and name. area_ha is the tagged one, else that of the thinned shape to one decimal; points have none. Relations
    without usable ways are no features and no problems. Repeated ids are expected to be one relation. Steps are written, so that no task holds the sorts of all of them.
    """
    rows = materialize(rows.select("id", "tags", "members"), "relations")
    tags = rows.select("id", "tags")
    rings, points = shapes(rows)
    first = materialize(measured(rings), "measured")
    off = (F.abs("lat") > 90) | (F.abs("lon") > 180)
    good = rings.join(first.where("problem IS NULL").select("id"), "id", "left_semi")
    labels = materialize(geometry.label_points(ring_edges(good)).withColumnRenamed("region", "id"), "labels")
    thin = materialize(geometry.simplify_rings(good, most), "thin-rings")
    second = materialize(measured(thin), "measured")
    ha = second.where("problem IS NULL").select("id", N.js_round(F.col("km2") * 100, 1).alias("computed_ha"))
    placed = labels.join(ha, "id").select("id", "lat", "lon", "computed_ha", F.lit("polygon").alias("kind")).union(points.where(~off).select("id", "lat", "lon", F.lit(None).cast("double"), F.lit("point")))
    placed = materialize(placed, "placed")
    named = placed.join(tags, "id")
    inside = territory.likely_inside("lat", "lon", F.col("tags")["name"], F.col("tags")["name:ru"])
    held = spatial.regions_containing(placed.select("id", "lat", "lon"), regions)
    held = materialize(held.select("id").distinct(), "held")
    out = named.where(inside).join(held, "id", "left_semi").select("id", "kind", *territory.area_features())
    bad = first.where("problem IS NOT NULL").select("id", "problem").union(second.where("problem IS NOT NULL").select("id", F.concat("problem", F.lit(" after simplification")))).union(points.where(off).select("id", F.lit("off the globe")))
    return out, thin, bad


def list_verdict(found: DataFrame, problems: DataFrame, last_good: int | None, least: int = 20) -> DataFrame:
    """One row: kept, dropped, problem: why the list mustn't replace the last good one (too few, or fewer than half of it); null when it may."""
    n, bad = found.agg(F.count(F.lit(1)).alias("kept")), problems.agg(F.count(F.lit(1)).alias("dropped"))
    return n.crossJoin(bad).withColumn("problem", status.count_problem(F.col("kept"), F.lit(last_good).cast("long"), least))  # one row each

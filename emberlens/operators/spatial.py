"""Spatial joins without geometry types: every one is an equi-join on grid cells or latitude bands, then an exact predicate.

Polygons come as an edge table: region, ord (position in the caller's list), polygon, ring, hole (boolean), x1, y1, x2, y2.
Points come with a unique id and double columns lat, lon. Nothing is broadcast by hand; Spark picks the join, and splits skewed cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.functions import numeric as N
from emberlens.operators.components import connected_components
from emberlens.shared import materialize, whole_side

#: Side in degrees of the cells through which points meet polygons, and height of the bands in which they meet edges.
CELL_DEG, BAND_DEG = 0.25, 0.02
#: Parts of a small cell along each side in clustering.
QUARTERS = 4
#: Cells this near an edge count as touched by it, so that rounding can't matter.
EDGE_PAD = 1e-9


def edges_of(polygons: DataFrame) -> DataFrame:
    """(region, ord, polygons array<polygon array<ring array<struct<lon, lat>>>>) -> edge table. The first ring of a polygon is its outer one."""
    rings = polygons.select("region", "ord", F.posexplode("polygons").alias("polygon", "rings")).select("region", "ord", "polygon", F.posexplode("rings").alias("ring", "points"))
    ends = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))
    return rings.where(F.size("points") > 1).select("region", "ord", "polygon", "ring", (F.col("ring") > 0).alias("hole"), F.explode(ends).alias("e")).select("region", "ord", "polygon", "ring", "hole", "e.*")


def bands(low, high, size: float = BAND_DEG) -> Column:
    return F.explode(F.sequence(N.row_of(low, size), N.row_of(high, size)))


def polygon_cells(edges: DataFrame, size: float = CELL_DEG) -> DataFrame:
    """Edge table -> region, ord, polygon, x, y, whole: the cells of a degree grid that a polygon meets; whole: no edge is near, and all of it is inside.

    Cells that an edge comes near are found row by row from the part of the edge in that row; what lies between a ring's crossings of a
    row's middle and isn't one of them is inside the ring. Cells that are all in a hole are left out.
    """
    own = ["region", "ord", "polygon"]
    e = edges.select(*own, "ring", "hole", "x1", "y1", "x2", "y2", bands(F.least("y1", "y2") - EDGE_PAD, F.greatest("y1", "y2") + EDGE_PAD, size).alias("y"))
    low, high = F.col("y") * size - EDGE_PAD, (F.col("y") + 1) * size + EDGE_PAD
    at = lambda lat: F.col("x1") + (F.col("x2") - F.col("x1")) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lat - F.col("y1")) / (F.col("y2") - F.col("y1"))))
    flat = F.col("y1") == F.col("y2")
    ends = F.when(flat, F.array("x1", "x2")).otherwise(F.array(at(low), at(high)))
    edge_cells = e.select(*own, "ring", "hole", "y", F.explode(F.sequence(N.row_of(F.array_min(ends) - EDGE_PAD, size), N.row_of(F.array_max(ends) + EDGE_PAD, size))).alias("x")).distinct()
    spans = scan_rows(edges, size, [*own, "ring", "hole"])
    columns = F.sequence(F.ceil(F.col("low") / size - 0.5).cast("long"), F.floor(F.col("high") / size - 0.5).cast("long"))
    middle = spans.where(F.ceil(F.col("low") / size - 0.5) <= F.floor(F.col("high") / size - 0.5)).select(*own, "ring", "hole", F.col("row").alias("y"), F.explode(columns).alias("x"))
    marked = edge_cells.withColumn("edge", F.lit(True)).union(middle.select(*edge_cells.columns).withColumn("edge", F.lit(False)))
    by_ring = marked.groupBy(*own, "ring", "hole", "x", "y").agg(F.bool_or("edge").alias("edge"))
    cells = by_ring.groupBy(*own, "x", "y").agg(F.bool_or("edge").alias("edge"), F.bool_or(F.col("hole") & ~F.col("edge")).alias("gone"))
    return cells.where("NOT gone").select(*own, "x", "y", (~F.col("edge")).alias("whole"))


def _hits(points: DataFrame, edges: DataFrame, keep: list[str]) -> DataFrame:
    """As regions_containing, with the points' columns ``keep``; a region may come twice for a point in two of its polygons."""
    cells = materialize(polygon_cells(edges), "polygon-cells")
    p = points.select("id", "lat", "lon", *keep).withColumns({"x": N.row_of("lon", CELL_DEG), "y": N.row_of("lat", CELL_DEG)})
    whole = p.join(cells.where("whole"), ["x", "y"]).select("id", "region", "ord", *keep)
    asked = p.join(cells.where("NOT whole"), ["x", "y"]).withColumn("band", N.row_of("lat", BAND_DEG)).drop("x", "y")
    e = edges.withColumn("band", bands(F.least("y1", "y2"), F.greatest("y1", "y2")))
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    left_of = F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    crossed = asked.join(e, ["region", "ord", "polygon", "band"]).where(spans & left_of).groupBy("id", "region", "ord", "polygon", "ring", "hole", *keep).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    polygons = crossed.groupBy("id", "region", "ord", "polygon", *keep).agg(F.bool_or("hole").alias("in_hole"))
    return whole.union(polygons.where("NOT in_hole").select("id", "region", "ord", *keep))


def regions_containing(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, lat, lon) x edges -> (id, region, ord) for every region that contains a point: in an outer ring, in no hole of that polygon.

    Points meet polygons through the cells of a grid. In a cell that no edge comes near the answer is the cell's; elsewhere a point meets the edges
    of that one polygon in a narrow band of latitude: even-odd ray cast. Null coordinates are in no region.
    """
    return _hits(points, edges, []).distinct()


def first_region(points: DataFrame, edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(id, region, and the points' columns ``keep``): the first region in list order that contains the point; points in none are left out."""
    keep = keep or []
    hits = _hits(points, edges, keep)
    return hits.groupBy("id").agg(F.min_by("region", "ord").alias("region"), *[F.first(c).alias(c) for c in keep])


def _columns_of(row: Column, step: float) -> Column:
    """How many columns a row of the distance grid has, so that each is at least ``step`` high in km terms anywhere in it."""
    edge = (F.abs(row + 0.5) + 1.5) * step
    return F.greatest(F.lit(1.0), F.floor(F.lit(360.0) / F.lit(step) * F.cos(N.radians(F.least(F.lit(89.99), edge))))).cast("long")


def _cell(row: Column, lon: Column, step: float) -> Column:
    n = _columns_of(row, step)
    return F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * n / 360.0).cast("long"), n)


def near_pairs(left: DataFrame, right: DataFrame, max_km: float) -> DataFrame:
    """(id, lat, lon) x (id, lat, lon) -> (a, b, km) for all pairs at most ``max_km`` apart, across the antimeridian too.

    Each left point asks the three by three cells around it.
    """
    step = max_km / 111.0
    row = N.row_of("lat", step)
    asks = left.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(F.sequence(row - 1, row + 1)).alias("row"))
    n = _columns_of(F.col("row"), step)
    near = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(_cell(F.col("row"), F.col("lon_a"), step) + d, n)))
    asks = asks.select("a", "lat_a", "lon_a", "row", F.explode(near).alias("cell"))
    held = right.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), row.alias("row")).withColumn("cell", _cell(F.col("row"), F.col("lon_b"), step))
    km = N.haversine_km("lat_a", "lon_a", "lat_b", "lon_b")
    return asks.join(whole_side(held), ["row", "cell"]).withColumn("km", km).where(F.col("km") <= max_km).select("a", "b", "km")


def distance_pairs(points: DataFrame, max_km: float) -> DataFrame:
    """Pairs a < b of one table at most ``max_km`` apart."""
    return near_pairs(points, points, max_km).where("a < b")


def single_linkage(points: DataFrame, max_km: float) -> DataFrame:
    """(id, lat, lon) -> (id, cluster): connected by hops of at most ``max_km``; a cluster is named by its smallest id.

    All points of one small cell (its diagonal is below ``max_km``) are in one cluster, so the graph's nodes are the cells. Cells are cut into
    QUARTERS by QUARTERS parts with one point each to stand for them: two cells are linked where two such points are near enough, which takes a
    bounded number of comparisons for a cell however dense it is. Only where none are, but points beside them could be, do all points of
    two parts meet. Above 89 degrees of latitude every spot is a cell.
    """
    side = max_km / 111.2 / 1.5
    row = N.row_of("lat", side)
    flat = F.col("lon") * F.cos((F.abs(F.col("row") + 0.5) + 0.5) * side * math.pi / 180.0) / side
    cell = F.when(F.abs(F.col("lat")) > 89, F.xxhash64("lat", "lon")).otherwise(F.floor(flat).cast("long"))
    part = lambda c: F.floor((c - F.floor(c)) * QUARTERS).cast("int")
    small = points.select("id", "lat", "lon", row.alias("row")).withColumn("cell", cell).withColumn("part", part(F.col("lat") / side) * QUARTERS + part(flat))
    spots = materialize(small.groupBy("row", "cell", "part", "lat", "lon").agg(F.min("id").alias("id")), "spots")
    heads = spots.groupBy("row", "cell").agg(F.min("id").alias("node"))
    stand = spots.groupBy("row", "cell", "part").agg(F.min_by(F.struct("lat", "lon"), "id").alias("at"), F.min("id").alias("id")).join(heads, ["row", "cell"])
    stand = materialize(stand.select("id", "at.lat", "at.lon", "node", "row", "cell", "part"), "spot-parts")
    reach = 2 * max_km / QUARTERS  # two parts are wider by less than this than the two points that stand for them
    noded = stand.select(F.struct("id", "node").alias("id"), "lat", "lon")
    pairs = near_pairs(noded, noded, max_km + reach).where("a.id < b.id AND a.node <> b.node")
    pairs = materialize(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "km", F.least("a.node", "b.node").alias("low"), F.greatest("a.node", "b.node").alias("high")), "spot-pairs")
    linked = pairs.where(F.col("km") <= max_km).select("low", "high").distinct()
    unsure = pairs.where(F.col("km") > max_km).join(linked, ["low", "high"], "left_anti")

    def members(side_: str) -> DataFrame:
        held = spots.join(stand.select("row", "cell", "part", F.col("id").alias(side_)), ["row", "cell", "part"])
        return held.select(side_, F.col("lat").alias(f"lat_{side_}"), F.col("lon").alias(f"lon_{side_}"))

    close = unsure.join(members("a"), "a").join(members("b"), "b").where(N.haversine_km("lat_a", "lon_a", "lat_b", "lon_b") <= max_km)
    labels = connected_components(linked.union(close.select("low", "high")).select(F.col("low").alias("a"), F.col("high").alias("b")))
    named = heads.join(labels, "node", "left").select("row", "cell", F.coalesce("component", "node").alias("cluster"))
    return small.join(whole_side(named), ["row", "cell"]).select("id", "cluster")


def _box_cells(west, south, east, north, size: float) -> Column:
    """Cells of a degree grid that a box touches, as structs (x, y). The grid goes round: a box may reach beyond 180 degrees either way. ``size`` divides 360."""
    round_ = round(360 / size)
    first = N.row_of(west, size)
    xs = F.transform(F.sequence(first, F.least(N.row_of(east, size), first + round_ - 1)), lambda x: F.pmod(x, F.lit(round_).cast("long")))
    ys = F.sequence(N.row_of(south, size), N.row_of(north, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _point_cell(lon, lat, size: float) -> Column:
    return F.struct(F.pmod(N.row_of(lon, size), F.lit(round(360 / size)).cast("long")).alias("x"), N.row_of(lat, size).alias("y"))


def _lon_within(lon, west, east) -> Column:
    """Whether a longitude lies in a box whose sides may be beyond 180 degrees; whole turns make no difference."""
    lon, west, east = map(N.num, (lon, west, east))
    return lon.between(west, east) | (lon + 360.0).between(west, east) | (lon - 360.0).between(west, east)


def _shorter_way(lon1, lon2) -> tuple[Column, Column]:
    """West and east of the two longitudes' span on the shorter way; east is beyond 180 where that crosses the antimeridian."""
    low, high = F.least(lon1, lon2), F.greatest(lon1, lon2)
    across = high - low > 180.0
    return F.when(across, high).otherwise(low), F.when(across, low + 360.0).otherwise(high)


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 0.25) -> DataFrame:
    """(id, lat, lon, ...) x (box, west, south, east, north, ...) -> both sides' columns for every point in a box, bounds included. Boxes may reach across the antimeridian, with a side beyond 180 degrees."""
    b = boxes.where(N.valid_bbox("west", "south", "east", "north")).withColumn("cell", F.explode(_box_cells("west", "south", "east", "north", size)))
    p = points.withColumn("cell", _point_cell("lon", "lat", size))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & _lon_within("lon", "west", "east")
    return p.join(b, "cell").where(inside).drop("cell")


def boxes_touched(boxes: DataFrame, spots: DataFrame, km: float, size: float = 0.25) -> DataFrame:
    """Boxes (box, west, south, east, north) x spots (lat, lon) -> (box) of those that have a spot inside them or within ``km`` of a side; the distance in longitude is
    measured at the spot's latitude. A semi-join of ranges: both sides meet in the cells they cover, so no pair is made twice over."""
    lat = km / N.KM_PER_DEG
    shrink = F.greatest(F.lit(0.01), F.cos(N.radians("lat")))
    s = spots.select("lat", "lon", (lat / shrink).alias("pad")).distinct()
    s = s.withColumn("cell", F.explode(_box_cells(F.col("lon") - F.col("pad"), F.col("lat") - lat, F.col("lon") + F.col("pad"), F.col("lat") + lat, size)))
    b = boxes.where(N.valid_bbox("west", "south", "east", "north")).withColumn("own_cell", F.explode(_box_cells("west", "south", "east", "north", size)))
    near = (F.col("lat") >= F.col("south") - lat) & (F.col("lat") <= F.col("north") + lat) & (F.col("lon") >= F.col("west") - F.col("pad")) & (F.col("lon") <= F.col("east") + F.col("pad"))
    return b.join(whole_side(s), (F.col("own_cell") == F.col("cell")) & near, "left_semi").select("box").distinct()


def _padded(west, south, east, north, km: float) -> list[Column]:
    lat = km / 110.5
    shrink = F.greatest(F.lit(0.01), F.cos(N.radians(F.least(F.lit(89.9), F.greatest(F.abs(N.num(south)), F.abs(N.num(north))) + lat))))
    return [N.num(west) - lat / shrink, N.num(south) - lat, N.num(east) + lat / shrink, N.num(north) + lat]


def nearest_segment(points: DataFrame, segments: DataFrame, max_km: float, keep: list[str], size: float = 0.25) -> DataFrame:
    """(id, lat, lon) x (ord, lat1, lon1, lat2, lon2, ...) -> id, km and ``keep`` of the nearest segment within ``max_km``, ties to the smaller ord, across the antimeridian too.

    Spots meet lines: points at one place ask once, and of segments with the same ends the one with the smallest ord answers for all.
    """
    ends = ["lat1", "lon1", "lat2", "lon2"]
    lines = segments.groupBy(*ends).agg(F.min_by(F.struct("ord", *keep), F.struct("ord")).alias("line"))
    (west, east), south, north = _shorter_way(F.col("lon1"), F.col("lon2")), F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    names = ["west", "south", "east", "north"]
    boxed = lines.withColumns(dict(zip(names, _padded(west, south, east, north, max_km), strict=True)))
    km = N.segment_km("lat", "lon", *ends)
    met = points_in_boxes(points.select("lat", "lon").distinct(), boxed, size).withColumn("km", km).where(F.col("km") <= max_km)
    return _nearest_of(points, met, "line", keep)


def nearest_point(points: DataFrame, places: DataFrame, max_km: float, keep: list[str]) -> DataFrame:
    """(id, lat, lon) x (ord, lat, lon, ...) -> id, km and ``keep`` of the nearest place within ``max_km``, ties to the smaller ord. Spots meet spots, as in nearest_segment."""
    spots = points.select("lat", "lon").distinct().withColumn("id", F.struct("lat", "lon"))
    held = places.groupBy("lat", "lon").agg(F.min_by(F.struct("ord", *keep), F.struct("ord")).alias("id"))
    return _nearest_of(points, near_pairs(spots, held, max_km).select("a.lat", "a.lon", "b", "km"), "b", keep)


def _nearest_of(points: DataFrame, met: DataFrame, found: str, keep: list[str]) -> DataFrame:
    """(id, lat, lon) x (lat, lon, km, a struct ``found`` of ord and ``keep``) -> id, km and ``keep`` of what is nearest to each point's spot."""
    best = met.groupBy("lat", "lon").agg(F.min_by(F.struct("km", *[F.col(found)[c].alias(c) for c in keep]), F.struct("km", F.col(found)["ord"])).alias("best"))
    return points.select("id", "lat", "lon").join(whole_side(best), ["lat", "lon"]).select("id", "best.*")


def area_relation(points: DataFrame, edges: DataFrame, areas: DataFrame, max_km: float = 50.0, size: float = 0.5) -> DataFrame:
    """(id, lat, lon) x areas (region, area) -> id, relation 'inside' | 'near' | 'none', region, km.

    Inside: the smallest of the areas that contain the point, else the one with the nearest boundary within ``max_km``, ties to the smaller ord.
    """
    inside = regions_containing(points, edges).join(areas, "region").groupBy("id").agg(F.min_by("region", F.struct("area", "ord")).alias("inside"))
    names = ["west", "south", "east", "north"]
    west, east = _shorter_way(F.col("x1"), F.col("x2"))
    boxed = edges.withColumns(dict(zip(names, _padded(west, F.least("y1", "y2"), east, F.greatest("y1", "y2"), max_km), strict=True)))
    km = N.boundary_km("lat", "lon", "y1", "x1", "y2", "x2")
    met = points_in_boxes(points.select("id", "lat", "lon"), boxed, size).withColumn("km", km).where(F.col("km") <= max_km)
    near = met.groupBy("id").agg(F.min_by(F.struct("km", "region"), F.struct("km", "ord")).alias("near"))
    out = points.select("id").join(inside, "id", "left").join(near, "id", "left")
    return out.select(
        "id",
        F.when(F.col("inside").isNotNull(), "inside").when(F.col("near").isNotNull(), "near").otherwise("none").alias("relation"),
        F.coalesce("inside", "near.region").alias("region"),
        F.when(F.col("inside").isNotNull(), F.lit(0.0)).otherwise(F.col("near.km")).alias("km"),
    )


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high) -> disjoint intervals, touching ones joined: gaps and islands."""
    before = W.partitionBy(*keys).orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("low", "high").rowsBetween(W.unboundedPreceding, 0)
    starts = rows.where("low <= high").withColumn("reach", F.max("high").over(before)).withColumn("new", (F.col("reach").isNull() | (F.col("low") > F.col("reach"))).cast("int"))
    return starts.withColumn("island", F.sum("new").over(upto)).groupBy(*keys, "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def overlap_length(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length): how much of merged intervals a lies in merged intervals b."""
    both = a.join(b.withColumnsRenamed({"low": "low_b", "high": "high_b"}), keys)
    return both.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), F.least("high", "high_b") - F.greatest("low", "low_b"))).alias("length"))


def scan_rows(edges: DataFrame, step: float, names: list[str]) -> DataFrame:
    """Where polygons cross the middle of each row of a grid: names, row, low, high (longitudes inside).

    Holes need no care: crossings of all rings of one polygon in order of longitude alternate between in and out.
    """
    rows = F.sequence(N.row_of(F.least("y1", "y2"), step), N.row_of(F.greatest("y1", "y2"), step))
    own = list(dict.fromkeys([*names, "region", "polygon"]))
    hit = edges.select(*own, "x1", "y1", "x2", "y2", F.explode(rows).alias("row")).withColumn("lat", (F.col("row") + 0.5) * step)
    hit = hit.where((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat")))
    x = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    order = W.partitionBy(*own, "row").orderBy("x")
    spans = hit.withColumn("x", x).withColumn("high", F.lead("x").over(order)).withColumn("n", F.row_number().over(order))
    return spans.where("n % 2 = 1 AND high IS NOT NULL").select(*names, "row", F.col("x").alias("low"), "high")


def covered_area_km2(areas: DataFrame, regions: DataFrame, step: float = 0.02) -> DataFrame:
    """(region, km2): how much of each region the union of all areas covers, on a grid of rows; both are edge tables."""
    union = merge_intervals(scan_rows(areas, step, []), ["row"])
    own = merge_intervals(scan_rows(regions, step, ["region"]), ["region", "row"])
    both = own.join(union.withColumnsRenamed({"low": "low_b", "high": "high_b"}), "row")
    width = F.greatest(F.lit(0.0), F.least("high", "high_b") - F.greatest("low", "low_b"))
    return both.groupBy("region").agg(F.sum(N.cell_area_km2(F.col("row") * step, step, width)).alias("km2"))

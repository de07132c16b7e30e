"""Fire incidents: heat cells, the static-source mask, clusters to incidents, incremental merge and the plan of a run.

Observations have id, lat, lon, acquired_at, satellite, confidence, frp, region_iso, region. An incident's state is one row (STATE).
Times are compared against an explicit ``as_of``; nothing reads the clock.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.functions import numeric as N
from emberlens.operators import spatial
from emberlens.shared import materialize, whole_side

# The incident method's parameters.
METHOD = "firms-cluster-v1"
WINDOW_HOURS = 72
INACTIVE_AFTER_HOURS = 48
LINK_KM = 2.0
STATIC_MIN_DAYS = 4
STATIC_WINDOW_DAYS = 14
STATIC_MIN_SPAN_DAYS = 7
STATIC_RADIUS_KM = 0.5
STATIC_STATUS = "static_source"

STATE = [
    "incident_id", "cluster_key", "region_iso", "region", "hotspot_count", "high_count", "pixel_count", "frp_max", "frp_sum", "first_seen", "last_seen",
    "status", "max_hotspot_id", "center_lat", "center_lng", "bbox_min_lat", "bbox_min_lng", "bbox_max_lat", "bbox_max_lng", "satellite",
]


def status_at(last_seen, as_of) -> Column:
    late = F.col(as_of) if isinstance(as_of, str) else as_of
    return F.when(late - F.expr(f"INTERVAL '{INACTIVE_AFTER_HOURS}' HOUR") > last_seen, "inactive").otherwise("active")


def in_window(points: DataFrame, as_of: Column, hours: int = WINDOW_HOURS) -> DataFrame:
    return points.where(F.col("acquired_at") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR"))


# ---- static sources
def heat_cells(points: DataFrame, min_days: int = 2) -> DataFrame:
    """row, col, lat, lon (means), days (sorted, distinct): cells of the 0.004 degree grid seen on at least ``min_days`` days."""
    cells = points.withColumn("row", N.heat_row("lat")).withColumn("col", N.heat_col("row", "lon"))
    days = cells.groupBy("row", "col").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.array_sort(F.collect_set(F.to_date("acquired_at"))).alias("days"))
    return days.where(F.size("days") >= min_days)


def days_near(points: DataFrame, cells: DataFrame, radius_km: float = STATIC_RADIUS_KM) -> DataFrame:
    """(id, lat, lon) x heat cells -> id, days: distinct days of all cells whose mean lies within the radius.

    Each cell with points gets the list of the heat cells around it, a bounded number, and a point looks through its own cell's list. So heat cells are copied, not points.
    """
    reach = math.ceil(radius_km / (N.HEAT_CELL_DEG * N.KM_PER_DEG)) + 1
    asks = points.select("id", "lat", "lon", N.heat_row("lat").alias("row")).withColumn("col", N.heat_col("row", "lon"))
    held = cells.select(F.struct("lat", "lon", "days").alias("cell"), F.explode(F.sequence(N.heat_row("lat") - reach, N.heat_row("lat") + reach)).alias("row"))
    centre = N.heat_col("row", F.col("cell.lon"))
    held = held.select("cell", "row", F.explode(F.sequence(centre - reach, centre + reach)).alias("col"))
    around = held.join(whole_side(asks.select("row", "col").distinct()), ["row", "col"], "left_semi").groupBy("row", "col").agg(F.collect_list("cell").alias("around"))
    near = F.filter("around", lambda c: N.haversine_km(F.col("lat"), F.col("lon"), c["lat"], c["lon"]) <= radius_km)
    days = F.array_sort(F.array_distinct(F.flatten(F.transform(near, lambda c: c["days"]))))
    return asks.join(whole_side(around), ["row", "col"]).select("id", days.alias("days")).where(F.size("days") > 0)


def is_static(days: Column) -> Column:
    """At least four distinct days that span a week."""
    return (F.size(days) >= STATIC_MIN_DAYS) & (F.datediff(F.element_at(days, -1), F.element_at(days, 1)) >= STATIC_MIN_SPAN_DAYS)


def window_start(as_of: Column) -> Column:
    """First day of the static mask's window: ``as_of`` and the days before it, 14 in all."""
    return F.date_sub(F.to_date(as_of), STATIC_WINDOW_DAYS - 1)


def static_points(points: DataFrame, history: DataFrame, as_of: Column, archive: DataFrame | None = None) -> DataFrame:
    """(id) of the points at static sources: by the last 14 days of ``history``, or because the archive lists their cell (row, col)."""
    recent = history.where(F.to_date("acquired_at") >= window_start(as_of))
    near = days_near(points, heat_cells(recent)).where(is_static(F.col("days"))).select("id")
    if archive is None:
        return near
    listed = points.withColumn("row", N.heat_row("lat")).withColumn("col", N.heat_col("row", "lon")).join(whole_side(archive.select("row", "col")), ["row", "col"], "left_semi")
    return near.union(listed.select("id")).distinct()


def static_places(history: DataFrame, as_of: Column, archive: DataFrame | None = None) -> DataFrame:
    """(lat, lon) of the static places: heat cells of the last 14 days at whose own mean the day rule holds, and the centres of the archive's cells."""
    cells = materialize(heat_cells(history.where(F.to_date("acquired_at") >= window_start(as_of))).withColumn("id", F.struct("row", "col")), "heat-cells")
    own = days_near(cells, cells).where(is_static(F.col("days"))).select("id")
    places = cells.join(whole_side(own), "id", "left_semi").select("lat", "lon")
    if archive is None:
        return places
    lat, lon = N.heat_centre("row", "col")
    return places.union(archive.select(lat.alias("lat"), lon.alias("lon")))


def static_incidents(members: DataFrame, static: DataFrame) -> DataFrame:
    """(incident_id, id) x static ids -> incident_id of the incidents whose every observation is static."""
    marked = members.join(whole_side(static.withColumn("hit", F.lit(1))), "id", "left")
    return marked.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).where("n = hits").select("incident_id")


def split_static(points: DataFrame, static: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and the ids of the static ones -> (kept, masked)."""
    ids = whole_side(static.select("id"))
    return points.join(ids, "id", "left_anti"), points.join(ids, "id", "left_semi")


def open_incidents(state: DataFrame, as_of: Column) -> DataFrame:
    """Those a run looks at: no static sources, still marked active or seen since the first day of the mask's window (so quiet ones are relabelled too)."""
    return state.where((F.col("status") != STATIC_STATUS) & ((F.col("status") == "active") | (F.to_date("last_seen") >= window_start(as_of))))


def touched_incidents(state: DataFrame, history: DataFrame, as_of: Column, archive: DataFrame | None = None) -> DataFrame:
    """Rows of the state that a run looks at and that have a static place in or near their box: worth a look at their observations."""
    boxes = open_incidents(state, as_of).select(F.col("incident_id").alias("box"), F.col("bbox_min_lng").alias("west"), F.col("bbox_min_lat").alias("south"), F.col("bbox_max_lng").alias("east"), F.col("bbox_max_lat").alias("north"))
    hit = spatial.boxes_touched(boxes, static_places(history, as_of, archive), STATIC_RADIUS_KM)
    return state.join(hit.select(F.col("box").alias("incident_id")), "incident_id", "left_semi")


def static_relabels(state: DataFrame, points: DataFrame, history: DataFrame, as_of: Column, archive: DataFrame | None = None) -> DataFrame:
    """(incident_id): the incidents that become static sources: not one yet, active or seen in the mask's window, touched by a static place, with observations left among ``points``,
    and each of these at a static place. Only points in the boxes of touched incidents are asked about."""
    touched = materialize(touched_incidents(state, history, as_of, archive), "touched")
    return relabelled(touched, points, history, as_of, archive)


def relabelled(touched: DataFrame, points: DataFrame, history: DataFrame, as_of: Column, archive: DataFrame | None = None) -> DataFrame:
    """(incident_id) of the touched incidents whose every observation among ``points`` is static; those without any keep their status."""
    members = incident_points(touched, points)
    asked = points.join(whole_side(members.select("id").distinct()), "id", "left_semi")
    return static_incidents(members, static_points(asked, history, as_of, archive))


def with_relabels(state: DataFrame, relabels: DataFrame) -> DataFrame:
    """The state in which the relabelled incidents are static sources."""
    marked = state.join(relabels.select("incident_id", F.lit(STATIC_STATUS).alias("relabel")), "incident_id", "left")
    return marked.withColumn("status", F.coalesce("relabel", "status")).select(*STATE)


class Run(NamedTuple):
    """What a run found and did."""

    clustered: DataFrame
    masked: DataFrame
    relabels: DataFrame
    creates: DataFrame
    updates: DataFrame
    changes: DataFrame
    state: DataFrame


def run(points: DataFrame, state: DataFrame, relabels: DataFrame, static: DataFrame, as_of: Column) -> Run:
    """One run over the window's points: incidents that turned out static are relabelled first, so that no point falls to them; points at static places are left out;
    the rest is clustered and planned against the open incidents. Older ones stay as they are.

    ``relabels`` as by ``static_relabels``, ``static`` (id) as by ``static_points``. Run.state is the next state (STATE, all rows)."""
    kept, masked = split_static(points, static)
    clustered = materialize(cluster(kept), "clustered")
    before = materialize(with_relabels(state, relabels), "relabelled")
    creates, updates, changes = (materialize(x, tag) for x, tag in zip(plan(clustered, open_incidents(before, as_of), as_of), ("creates", "updates", "changes"), strict=True))
    return Run(clustered, masked, relabels, creates, updates, changes, next_state(before, creates, updates, changes))


def run_counters(creates: DataFrame, updates: DataFrame, changes: DataFrame, relabels: DataFrame, masked: DataFrame) -> DataFrame:
    """One row: created, updated, deactivated, activated, relabelled, masked (points): what a run did."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(creates, "created"), count(updates, "updated"), count(changes.where("status = 'inactive'"), "deactivated"), count(changes.where("status = 'active'"), "activated"), count(relabels, "relabelled"), count(masked, "masked")]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def method_parameters(archive_version: Column | None = None) -> Column:
    """The parameters of the incident method and of the static mask, to go with what was made by them."""
    numbers = {"cluster_km": LINK_KM, "match_km": LINK_KM, "window_hours": WINDOW_HOURS, "inactive_after_hours": INACTIVE_AFTER_HOURS, "static_min_days": STATIC_MIN_DAYS,
               "static_window_days": STATIC_WINDOW_DAYS, "static_min_span_days": STATIC_MIN_SPAN_DAYS, "static_radius_km": STATIC_RADIUS_KM}
    version = F.lit(None).cast("long") if archive_version is None else archive_version
    return F.struct(F.lit(METHOD).alias("method"), *[F.lit(v).alias(k) for k, v in numbers.items()], version.alias("archive_version"))


def imagery_geometry(incidents: DataFrame) -> DataFrame:
    """Incidents -> incident_id, w, s, e, n, lat, lon, first_seen, last_seen, problem: the box and centre that pictures are asked for.

    Without a box the centre stands for it, without either the problem is 'no geometry'. Dates fall back from first_seen and last_seen to detected_date.
    """
    box = [F.col(f"bbox_{c}") for c in ("min_lng", "min_lat", "max_lng", "max_lat")]
    whole = box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
    lat, lon = F.coalesce("center_lat", F.when(whole, (box[1] + box[3]) / 2)), F.coalesce("center_lng", F.when(whole, (box[0] + box[2]) / 2))
    sides = [F.when(whole, b).otherwise(F.when(lat.isNotNull() & lon.isNotNull(), c)).alias(k) for k, b, c in zip("wsen", box, (lon, lat, lon, lat), strict=True)]
    first = F.coalesce(F.to_date("first_seen"), F.col("detected_date"))
    last = F.coalesce(F.to_date("last_seen"), first)
    problem = F.when(lat.isNull() | lon.isNull(), "no geometry")
    return incidents.select("incident_id", *sides, lat.alias("lat"), lon.alias("lon"), first.alias("first_seen"), last.alias("last_seen"), problem.alias("problem"))


# ---- clusters to incidents
def cluster(points: DataFrame, max_km: float = LINK_KM) -> DataFrame:
    """Points with the cluster they belong to (its smallest id)."""
    return points.join(whole_side(spatial.single_linkage(points, max_km)), "id")


def satellites(lists: Column) -> Column:
    """An array of comma lists as one sorted comma list without repeats."""
    parts = F.filter(F.transform(F.flatten(F.transform(lists, lambda x: F.split(F.coalesce(x, F.lit("")), ","))), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), ",")


def _order() -> Column:
    return F.struct("acquired_at", "id")


def build_incidents(clustered: DataFrame, as_of: Column) -> DataFrame:
    """One row for each cluster with two points or a confident one (STATE without incident_id, with cluster), plus area_ha and confidence."""
    high = F.col("confidence") == "high"
    first = F.min_by(F.struct("id", "region_iso", "region"), _order())
    rows = clustered.groupBy("cluster").agg(
        first.alias("first"), F.count(F.lit(1)).alias("hotspot_count"), F.count_if(high).alias("high_count"),
        F.count_distinct(N.pixel_key("lat", "lon")).alias("pixel_count"), F.max("frp").alias("frp_max"),
        N.js_round(F.coalesce(F.sum("frp"), F.lit(0.0)), 2).alias("frp_sum"), F.min("acquired_at").alias("first_seen"), F.max("acquired_at").alias("last_seen"),
        F.max("id").alias("max_hotspot_id"), N.js_round(F.avg("lat"), 6).alias("center_lat"), N.js_round(F.avg("lon"), 6).alias("center_lng"),
        F.min("lat").alias("bbox_min_lat"), F.min("lon").alias("bbox_min_lng"), F.max("lat").alias("bbox_max_lat"), F.max("lon").alias("bbox_max_lng"),
        satellites(F.collect_set("satellite")).alias("satellite"),
    )
    rows = rows.where("hotspot_count >= 2 OR high_count > 0").withColumn("status", status_at(F.col("last_seen"), as_of))
    out = rows.select("cluster", F.col("first.id").cast("string").alias("cluster_key"), "first.region_iso", "first.region", *[c for c in STATE if c not in ("incident_id", "cluster_key", "region_iso", "region")])
    return with_measures(out)


def with_measures(state: DataFrame) -> DataFrame:
    """Adds area_ha and confidence, which follow from the counts."""
    return state.withColumn("area_ha", N.pixel_area_ha("pixel_count")).withColumn("confidence", F.coalesce(N.js_round(N.safe_div("high_count", "hotspot_count"), 2), F.lit(0.0)))


def is_matchable(as_of: Column) -> Column:
    """Open for new points: not a static source, last seen in the window."""
    return (F.col("status") != STATIC_STATUS) & (F.col("last_seen") >= as_of - F.expr(f"INTERVAL '{WINDOW_HOURS}' HOUR"))


def _box(prefix: str) -> dict[str, Column]:
    return {"s": F.col(f"{prefix}_s"), "w": F.col(f"{prefix}_w"), "n": F.col(f"{prefix}_n"), "e": F.col(f"{prefix}_e")}


def match_clusters(clustered: DataFrame, state: DataFrame, as_of: Column, size: float = 0.5) -> DataFrame:
    """(cluster, incident_id): the matchable incident whose box is nearest, at most 2 km away; ties to the smaller incident_id.

    Boxes meet through the cells of a degree grid they touch, each padded by the bound.
    """
    names = ["w", "s", "e", "n"]
    boxes = clustered.groupBy("cluster").agg(F.min("lon").alias("c_w"), F.min("lat").alias("c_s"), F.max("lon").alias("c_e"), F.max("lat").alias("c_n"))
    open_ = state.where(is_matchable(as_of)).select("incident_id", F.col("bbox_min_lng").alias("i_w"), F.col("bbox_min_lat").alias("i_s"), F.col("bbox_max_lng").alias("i_e"), F.col("bbox_max_lat").alias("i_n"))
    padded = spatial._padded(*[F.col(f"c_{k}") for k in names], LINK_KM * 1.01)  # cells go round, and gaps across the antimeridian are measured as such
    left = boxes.withColumn("cell", F.explode(spatial._box_cells(*padded, size)))
    right = open_.withColumn("cell", F.explode(spatial._box_cells(*[F.col(f"i_{k}") for k in names], size)))
    met = left.join(right, "cell").drop("cell").distinct().withColumn("km", N.bbox_distance_km(_box("c"), _box("i"))).where(F.col("km") <= LINK_KM)
    return met.groupBy("cluster").agg(F.min_by("incident_id", F.struct("km", "incident_id")).alias("incident_id"))


def merge_incidents(matched: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """Points with the incident they fall to, and its state -> the new state of incidents that got points above their watermark.

    Only ids above ``max_hotspot_id`` count. A pixel is new unless a counted point of the current window lies in it.
    """
    s = state.withColumnsRenamed({c: f"old_{c}" for c in STATE if c != "incident_id"})
    p = matched.join(s.select("incident_id", "old_max_hotspot_id"), "incident_id").withColumn("fresh", F.col("id") > F.col("old_max_hotspot_id")).withColumn("pixel", N.pixel_key("lat", "lon"))
    pixels = p.groupBy("incident_id", "pixel").agg(F.every("fresh").alias("new")).groupBy("incident_id").agg(F.count_if("new").alias("new_pixels"))
    fresh = p.where("fresh").groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("high"), F.max("frp").alias("frp_max"), F.coalesce(F.sum("frp"), F.lit(0.0)).alias("frp_sum"),
        F.min("acquired_at").alias("first"), F.max("acquired_at").alias("last"), F.max("id").alias("max_id"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"),
        F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n_lat"), F.max("lon").alias("e"), F.collect_set("satellite").alias("satellites"),
    )
    j = fresh.join(pixels, "incident_id").join(s, "incident_id")
    count = F.col("old_hotspot_count") + F.col("n")
    mean = lambda old, new: N.js_round((F.col(old) * F.col("old_hotspot_count") + F.col(new)) / count, 6)
    last = F.greatest("old_last_seen", "last")
    out = j.select(
        "incident_id", F.col("old_cluster_key").alias("cluster_key"), F.col("old_region_iso").alias("region_iso"), F.col("old_region").alias("region"),
        count.alias("hotspot_count"), (F.col("old_high_count") + F.col("high")).alias("high_count"), (F.col("old_pixel_count") + F.col("new_pixels")).alias("pixel_count"),
        F.greatest("old_frp_max", "frp_max").alias("frp_max"), N.js_round(F.col("old_frp_sum") + F.col("frp_sum"), 2).alias("frp_sum"),
        F.least("old_first_seen", "first").alias("first_seen"), last.alias("last_seen"), status_at(last, as_of).alias("status"),
        F.greatest("old_max_hotspot_id", "max_id").alias("max_hotspot_id"), mean("old_center_lat", "lat").alias("center_lat"), mean("old_center_lng", "lon").alias("center_lng"),
        F.least("old_bbox_min_lat", "s").alias("bbox_min_lat"), F.least("old_bbox_min_lng", "w").alias("bbox_min_lng"),
        F.greatest("old_bbox_max_lat", "n_lat").alias("bbox_max_lat"), F.greatest("old_bbox_max_lng", "e").alias("bbox_max_lng"),
        satellites(F.array_append("satellites", F.col("old_satellite"))).alias("satellite"),
    )
    return with_measures(out)


def plan(clustered: DataFrame, state: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run: (creates, updates, status changes). Clusters near an open incident go to it, several to one where that is nearest; others found new ones."""
    match = match_clusters(clustered, state, as_of)
    creates = build_incidents(clustered.join(match, "cluster", "left_anti"), as_of)
    updates = merge_incidents(clustered.join(match, "cluster"), state, as_of)
    rest = state.where(F.col("status") != STATIC_STATUS).join(updates.select("incident_id"), "incident_id", "left_anti")
    now = status_at(F.col("last_seen"), as_of)
    changes = rest.where(now != F.col("status")).select("incident_id", now.alias("status"))
    return creates, updates, changes


def next_state(state: DataFrame, creates: DataFrame, updates: DataFrame, changes: DataFrame, relabels: DataFrame | None = None) -> DataFrame:
    """The state after a plan: kept rows, changed status, updated rows, and new rows with ids after the largest, in cluster order.

    ``relabels`` (incident_id) are static sources from now on; an incident that is one stays one.

    The numbering is a running count within ranges of clusters, so no task sees all new rows.
    """
    kept = state.select(*STATE).join(updates.select("incident_id"), "incident_id", "left_anti").join(changes.withColumnRenamed("status", "new_status"), "incident_id", "left")
    kept = kept.withColumn("status", F.coalesce("new_status", "status")).select(*STATE)
    top = state.agg(F.coalesce(F.max("incident_id"), F.lit(0)).alias("top"))
    span = creates.agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    slot = F.floor((F.col("cluster") - F.col("low")) * 512 / (F.col("high") - F.col("low") + 1)).cast("int")
    slotted = creates.crossJoin(F.broadcast(span)).withColumn("slot", slot).drop("low", "high")  # one row
    counts = slotted.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))  # at most 512 rows
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = slotted.join(F.broadcast(before), "slot").crossJoin(F.broadcast(top))
    new = numbered.withColumn("incident_id", F.col("top") + F.col("before") + F.row_number().over(W.partitionBy("slot").orderBy("cluster")))
    out = kept.union(updates.select(*STATE)).union(new.select(*STATE))
    return out if relabels is None else with_relabels(out, relabels)


def incident_points(state: DataFrame, points: DataFrame, buffer_m: float = 0.0, most: int | None = None) -> DataFrame:
    """Each incident's own observations: in its box (with a buffer), first to last day, ids up to its watermark; the newest ``most`` of them.

    With ``most`` set, that is the feature: a card shows so many; rank tells the order.
    """
    pad = buffer_m / 1000.0 / N.KM_PER_DEG
    lat_pad, lon_pad = F.lit(pad), F.lit(pad) / F.greatest(F.lit(0.01), F.cos(N.radians("center_lat")))
    boxes = state.select(
        "incident_id", F.col("first_seen"), F.col("last_seen"), F.col("max_hotspot_id"),
        (F.col("bbox_min_lng") - lon_pad).alias("west"), (F.col("bbox_min_lat") - lat_pad).alias("south"), (F.col("bbox_max_lng") + lon_pad).alias("east"), (F.col("bbox_max_lat") + lat_pad).alias("north"),
    )
    met = spatial.points_in_boxes(points.select("id", "lat", "lon", "acquired_at"), boxes)
    met = met.where((F.to_date("acquired_at") >= F.to_date("first_seen")) & (F.to_date("acquired_at") <= F.to_date("last_seen")) & (F.col("id") <= F.col("max_hotspot_id")))
    if most is None:
        return met.select("incident_id", "id")
    order = W.partitionBy("incident_id").orderBy(F.desc("acquired_at"), F.desc("id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("incident_id", "id", "rank")

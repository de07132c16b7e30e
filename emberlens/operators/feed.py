"""The incident feed: a filtered, sorted, paged view of incidents joined to forest areas, its map layer and its exports.

A request is a dict of raw values. Unknown and malformed values are ignored, never put into a query's text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlens.functions import numeric as N, text as T

MAP_LIMIT = 500
EXPORT_LIMIT = 5000
MAX_ID = 2**31 - 1
STATIC_MODES = ("exclude", "include", "only")
STATUSES = ("active", "inactive")


def _orders() -> dict[str, list[Column]]:
    c = F.col
    return {
        "date_desc": [c("detected_date").desc()],
        "date_asc": [c("detected_date").asc()],
        "area_desc": [c("area_ha").desc_nulls_last()],
        "area_asc": [c("area_ha").asc_nulls_last()],
        "confidence_desc": [c("confidence").desc_nulls_last(), c("detected_date").desc()],
        "confidence_asc": [c("confidence").asc_nulls_last(), c("detected_date").desc()],
    }


def parse_request(raw: dict) -> dict:
    """The values of a request that hold: sort, limit, offset and filters by name."""
    text = {k: T.first_text(raw.get(k)) for k in ("sort", "static_sources", "id", "change_type", "severity", "region", "status", "source")}
    filters = {"static_sources": text["static_sources"] if text["static_sources"] in STATIC_MODES else "exclude"}
    if text["id"] and re.fullmatch(r"\d{1,10}", text["id"]) and 0 < int(text["id"]) <= MAX_ID:
        filters["id"] = int(text["id"])
    filters |= {k: text[k] for k in ("change_type", "severity", "region") if text[k]}
    if text["status"] in STATUSES:
        filters["status"] = text["status"]
    if text["source"] and re.fullmatch(r"[\w.\- ]{1,50}", text["source"], re.ASCII):
        filters["source"] = text["source"]
    filters |= {k: d for k in ("start_date", "end_date") if (d := T.iso_date(raw.get(k)))}
    return {"sort": text["sort"] if text["sort"] in _orders() else "date_desc", "limit": T.clamp_limit(raw.get("limit")), "offset": T.clamp_offset(raw.get("offset")), "filters": filters}


def cache_key(raw: dict) -> str:
    r = parse_request(raw)
    return f"incidents:sort={r['sort']}&limit={r['limit']}&offset={r['offset']}&" + "&".join(f"{k}={v}" for k, v in sorted(r["filters"].items()))


def with_region(incidents: DataFrame, areas: DataFrame) -> DataFrame:
    """Incidents left-joined to forest areas; the area's region wins over the incident's own (``own_region``)."""
    a = areas.select(F.col("id").alias("area_key"), F.col("region").alias("area_region"), F.col("name").alias("forest_area_name"))
    j = incidents.join(a, F.col("forest_area_id") == F.col("area_key"), "left")
    return j.withColumn("region", F.coalesce("area_region", "own_region")).drop("area_key", "area_region")


def condition(filters: dict) -> Column:
    not_static = F.coalesce("status", F.lit("")) != "static_source"
    parts = {"exclude": [not_static], "only": [F.col("status") == "static_source"], "include": []}[filters["static_sources"]]
    parts += [F.col(k) == v for k, v in filters.items() if k in ("id", "change_type", "severity", "region", "status", "source")]
    if "start_date" in filters:
        parts.append(F.col("detected_date") >= F.lit(filters["start_date"]).cast("date"))
    if "end_date" in filters:
        parts.append(F.col("detected_date") <= F.lit(filters["end_date"]).cast("date"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def matching(incidents: DataFrame, areas: DataFrame, raw: dict) -> DataFrame:
    return with_region(incidents, areas).where(condition(parse_request(raw)["filters"]))


def page(incidents: DataFrame, areas: DataFrame, raw: dict) -> DataFrame:
    """A page; ties go to the larger id, so pages are stable."""
    r = parse_request(raw)
    out = matching(incidents, areas, raw).orderBy(*_orders()[r["sort"]], F.desc("id"))
    return (out.offset(r["offset"]) if r["offset"] else out).limit(r["limit"])


def total(incidents: DataFrame, areas: DataFrame, raw: dict) -> DataFrame:
    return matching(incidents, areas, raw).agg(F.count(F.lit(1)).alias("total"))


def regions(incidents: DataFrame, areas: DataFrame) -> DataFrame:
    """All regions of areas and incidents, distinct, without null."""
    return areas.select("region").union(incidents.select(F.col("own_region").alias("region"))).where("region IS NOT NULL").distinct()


def map_layer(incidents: DataFrame, areas: DataFrame, raw: dict, limit: int = MAP_LIMIT) -> DataFrame:
    """The newest incidents of a map, with the same filters as the feed but no id, status, source or severity."""
    kept = {k: raw.get(k) for k in ("change_type", "region", "start_date", "end_date", "static_sources")}
    return matching(incidents, areas, kept).orderBy(F.desc("detected_date"), F.desc("id")).limit(limit)


def export(incidents: DataFrame, areas: DataFrame, raw: dict, limit: int = EXPORT_LIMIT) -> DataFrame:
    """The rows of an export and one more, which tells that there are too many."""
    r = parse_request(raw)
    return matching(incidents, areas, raw).orderBy(*_orders()[r["sort"]], F.desc("id")).limit(limit + 1)


def point_json(lon, lat) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":['), F.format_string("%.6f", N.num(lon)), F.lit(","), F.format_string("%.6f", N.num(lat)), F.lit("]}"))


def box_json(west, south, east, north) -> Column:
    w, s, e, n = (F.format_string("%.6f", N.num(x)) for x in (west, south, east, north))
    corners = F.concat_ws("],[", *[F.concat(x, F.lit(","), y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    return F.concat(F.lit('{"type":"Polygon","coordinates":[[['), corners, F.lit("]]]}"))


def geometry_json(stored, west, south, east, north, lon, lat) -> Column:
    """Stored geometry, else the box if it has an area, else the centre, else null."""
    box = F.when((N.num(east) > N.num(west)) & (N.num(north) > N.num(south)), box_json(west, south, east, north))
    return F.coalesce(stored, box, F.when(N.num(lon).isNotNull() & N.num(lat).isNotNull(), point_json(lon, lat)))


def feature_json(geometry: Column, properties: list[str]) -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}), F.lit("}"))


# Columns of an incident export in their order.
EXPORT_COLUMNS = (
    "id", "change_type", "status", "region", "region_iso", "detected_date", "first_seen", "last_seen", "center_lat", "center_lon", "bbox_min_lat", "bbox_min_lon", "bbox_max_lat", "bbox_max_lon",
    "area_ha", "area_note", "hotspot_count", "frp_max", "satellites", "severity", "confidence", "source", "method", "license", "url",
)


def export_rows(rows: DataFrame, licenses: DataFrame, site: str, method: str, area_note: str) -> DataFrame:
    """Matching incidents (their own columns, with method, status, region_iso, first_seen, last_seen, hotspot_count, frp_max as stored text) -> EXPORT_COLUMNS.

    Empty texts and numbers that aren't any are null. ``licenses`` (source, license) may lack a source. Rows made by ``method`` carry the note on their area.
    The link opens the map at the incident's centre, or the list where it has none.
    """
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    value = lambda c: F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double"))
    lat, lon = value("center_lat"), value("center_lng")
    shown = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    url = F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit(f"{site}/?lat="), shown(lat), F.lit("&lng="), shown(lon), F.lit("&incident="), F.col("id").cast("string")))
    made = {
        "id": F.col("id"), "detected_date": F.date_format("detected_date", "yyyy-MM-dd"), "center_lat": lat, "center_lon": lon, "bbox_min_lon": value("bbox_min_lng"), "bbox_max_lon": value("bbox_max_lng"),
        "area_note": F.when(F.col("method") == method, area_note), "satellites": text("satellite"), "license": F.col("license"), "url": F.coalesce(url, F.concat(F.lit(f"{site}/incidents?id="), F.col("id").cast("string"))),
    } | {c: value(c) for c in ("bbox_min_lat", "bbox_max_lat", "area_ha", "hotspot_count", "frp_max", "confidence")}
    j = rows.join(licenses.select("source", "license"), "source", "left")
    return j.select(*[(made[c] if c in made else text(c)).alias(c) for c in EXPORT_COLUMNS])


def export_metadata(rows: DataFrame, raw: dict, sources: DataFrame, method: Column, limit: int = EXPORT_LIMIT) -> DataFrame:
    """One row: dataset, filters, sort, limit, rows, too_many, sources (array of structs, by source), method: the block that goes with an export.

    ``rows`` are those of ``export``, one more than the limit at most; ``sources`` those of ``status.provenance``, a row for each source.
    """
    r = parse_request(raw)
    filters = F.create_map(*[F.lit(str(x)) for kv in sorted(r["filters"].items()) for x in kv])
    count = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.least("rows", F.lit(limit)).alias("rows"), (F.col("rows") > limit).alias("too_many"))
    named = sources.agg(F.array_sort(F.collect_list(F.struct(*["source", *[c for c in sources.columns if c != "source"]]))).alias("sources"))
    return count.crossJoin(named).select(F.lit("incidents").alias("dataset"), filters.alias("filters"), F.lit(r["sort"]).alias("sort"), F.lit(limit).alias("limit"), "rows", "too_many", "sources", method.alias("method"))

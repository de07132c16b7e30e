"""Readers of landed files. Everything is read as text under an explicit or header-given schema, then cast with checks.

Fetching is a matter of the platform that lands the files; a reader takes paths on any store that Spark reads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlens.functions import numeric as N, text as T
from emberlens.operators import status
from emberlens.shared import materialize
from emberlens.sources import sinks

# Columns of a detections file and what stands in for missing ones.
HOTSPOT_COLUMNS = ("latitude", "longitude", "brightness", "bright_t31", "frp", "scan", "track", "acq_date", "acq_time", "satellite", "confidence", "version", "daynight")
REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "frp", "confidence")
DEFAULTS = {"satellite": "VIIRS", "confidence": "nominal", "version": "2.0", "daynight": "D"}
BRIGHTNESS, BRIGHTNESS_31 = ("bright_ti4", "brightness"), ("bright_ti5",)
MOST_BAD = 0.05
# The country's box; east is beyond 180 degrees.
NATIONAL_BOX = (19.0, 40.0, 190.0, 82.0)
# Columns of official tables under their known spellings.
STATISTICS = {
    "forestland": {"name": ("subjects", "subject", "region", "name"), "value": ("area", "value"), "year": ("year",)},
    "forest_fund": {"name": ("region", "subjects", "subject", "name"), "value": ("total_materials", "total", "value"), "year": ("year",)},
    "woodiness": {"name": ("region", "subjects", "subject", "name"), "value": ("woodiness",), "year": ("year",)},
    "wood_volume": {"name": ("region", "subjects", "subject", "name"), "value": ("volume", "value"), "year": ("year",)},
}


def read_csv(spark: SparkSession, paths, **options) -> DataFrame:
    """All columns as text, names trimmed and in lower case, a byte-order mark dropped."""
    df = spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE", escape='"', enforceSchema=False, **options).csv(paths)
    return df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns]).withColumn("file", F.input_file_name())


def _pick(df: DataFrame, names: tuple[str, ...]) -> Column:
    have = [c for c in names if c in df.columns]
    return T.first_filled(*have) if have else F.lit(None).cast("string")


def detections_csv(spark: SparkSession, paths) -> DataFrame:
    """As read_csv, with ``short``: whether a row has fewer fields than the header."""
    names = [c.lstrip("\ufeff").strip().lower() for c in spark.read.options(header=True, inferSchema=False).csv(paths).columns]
    if not names:
        raise ValueError("empty file")
    schema = ", ".join(f"`{c}` string" for c in [*names, "_line"])
    # without pruning the parser sees all fields of a row, so it can tell that some are missing
    df = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line", columnPruning=False).csv(paths)
    short = F.coalesce(F.size(F.split("_line", ",")) < len(names), F.lit(False))
    return df.withColumn("short", short).drop("_line").withColumn("file", F.input_file_name())


def hotspots_raw(df: DataFrame) -> DataFrame:
    """A detections table under its standard columns, all text, with ``problem`` set for rows that can't be used. A table without a required column is refused."""
    missing = [c for c in REQUIRED if c not in df.columns] + ["|".join(BRIGHTNESS)] * (not any(c in df.columns for c in BRIGHTNESS))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    held = lambda names: next((F.col(c) for c in names if c in df.columns), F.lit(None).cast("string"))  # noqa: E731  the first column that is there, blank or not
    kinds = {"brightness": held(BRIGHTNESS), "bright_t31": held(BRIGHTNESS_31)}
    rest = [c for c in df.columns if c not in HOTSPOT_COLUMNS and c not in (*BRIGHTNESS, *BRIGHTNESS_31)]
    out = df.select(*[kinds.get(c, held((c,))).alias(c) for c in HOTSPOT_COLUMNS], *rest)
    if "short" not in df.columns:
        out = out.withColumn("short", F.lit(False))
    return out.withColumn("problem", status.problems_of([("fields", F.col("short")), *status.hotspot_rules()]))


def hotspots(raw: DataFrame, by: str = "file") -> DataFrame:
    """Usable rows of ``hotspots_raw``, typed and with defaults; files (or what else ``by`` names) with over 5 % bad rows (20 rows or more) are left out whole.

    Numbers that are blank or no numbers are 0, but the second brightness stays null."""
    bad_files = status.verdict(raw, [by], MOST_BAD).where("NOT passed").select(by)
    good = raw.where("problem IS NULL").join(bad_files, by, "left_anti")
    finite = lambda c: F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double"))
    number = lambda c: F.coalesce(finite(c), F.lit(0.0)).alias(c)
    return good.select(
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), number("brightness"), finite("bright_t31").alias("bright_t31"), *[number(c) for c in ("frp", "scan", "track")],
        "acq_date", "acq_time", *[T.first_filled(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()], *[c for c in ("file", "feed") if c in raw.columns],
    )


def archive_rows(df: DataFrame) -> DataFrame:
    """A yearly archive: lat, lon, year (the first four characters of the date), type, frp (blank or negative: 0), malformed (no place on earth, year or type)."""
    lat, lon, kind = (F.col(c).try_cast("double") for c in ("latitude", "longitude", "type"))
    year = F.substring(F.trim("acq_date"), 1, 4).try_cast("int")
    bad = [lat.isNull() | F.isnan(lat) | (F.abs(lat) > 90), lon.isNull() | F.isnan(lon) | (F.abs(lon) > 180), year.isNull(), kind.isNull() | (kind != F.floor(kind))]
    frp = F.greatest(F.coalesce(F.nanvl(F.col("frp").try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return df.select(lat.alias("lat"), lon.alias("lon"), year.alias("year"), kind.cast("int").alias("type"), frp.alias("frp"), reduce(lambda x, y: x | y, bad).alias("malformed"))


def statistics(df: DataFrame, dataset: str) -> DataFrame:
    """An official table -> name, value, year (null where blank or a placeholder), from whichever spelling of the columns it has."""
    spec = STATISTICS[dataset]
    for part in ("name", "value"):
        if not any(c in df.columns for c in spec[part]):
            raise ValueError(f"no {part} column for {dataset}")
    year = T.statistics_number(_pick(df, spec["year"]))
    return df.select(F.trim(_pick(df, spec["name"])).alias("name"), T.statistics_number(_pick(df, spec["value"])).alias("value"), F.when(year == F.floor(year), year).cast("int").alias("year"))


def active_fires(hotspots: DataFrame) -> DataFrame:
    """(n): detections of high or nominal confidence."""
    return hotspots.where(F.col("confidence").isin("high", "nominal")).agg(F.count(F.lit(1)).alias("n"))


def feed_rows(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, dict[str, str]]:
    """All rows of several feeds (name -> path) as ``hotspots_raw`` gives them, with ``feed``, written once for what reads them; and why feeds can't be read or have another header."""
    parts, failed = [], {}
    for name, path in paths.items():
        try:
            parts.append(hotspots_raw(detections_csv(spark, path)).withColumn("feed", F.lit(name)))
        except (ValueError, AnalysisException) as e:
            failed[name] = str(e).splitlines()[0][:200]
    return (materialize(reduce(DataFrame.unionByName, [p.select(*HOTSPOT_COLUMNS, "short", "file", "problem", "feed") for p in parts]), "feeds") if parts else None), failed


def feeds(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Usable detections of several feeds (name -> path), and why feeds were left out: they can't be read, have another header, or too many bad rows.

    Feeds fail each on its own. An error when no feed has a usable row."""
    raw, failed = feed_rows(spark, paths)
    rows = 0
    if raw is not None:
        for v in status.verdict(raw, ["feed"], MOST_BAD).collect():  # a row for each feed
            if v.passed:
                rows += v.total - v.rejected
            else:
                failed[v.feed] = f"{v.rejected} of {v.total} rows are invalid"
    if not rows:
        raise ValueError(f"all feeds failed: {failed}")
    return hotspots(raw, "feed"), failed


def snapshot(found: DataFrame, order: list[Column], box: tuple[float, float, float, float] = NATIONAL_BOX) -> DataFrame:
    """Detections of all feeds as they are shown: one for each 0.01 degree cell (the strongest, of equals the first in ``order``), then those in the box."""
    return sinks.dedupe_grid(found, order).where(N.in_bbox("latitude", "longitude", *box))


def feature_lines(spark: SparkSession, path: str, keep: dict[str, tuple] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Line-delimited GeoJSON (a record separator before a line does no harm) -> properties, kind, coordinates of the features whose properties have one of
    the values that ``keep`` lists for them. Lines beyond ``max_bytes`` raise an error when they are read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x1e", "").alias("value")).where(F.trim("value") != "")
    if max_bytes:
        lines = lines.withColumn("value", F.when(F.octet_length("value") <= max_bytes, F.col("value")).otherwise(F.raise_error(F.lit("a feature is too large"))))
    f = lines.select(F.from_json("value", "properties map<string, string>, geometry struct<type: string, coordinates: string>").alias("f"))
    out = f.select("f.properties", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates").where("kind IS NOT NULL")
    for name, values in (keep or {}).items():
        out = out.where(F.col("properties")[name].isin(*values))
    return out


def oversized(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """(path, length) of the landed files that are too large to be what they should be; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > max_bytes)


def expected(regions: DataFrame, isos: list[str]) -> DataFrame:
    """Boundaries of the regions asked for; reading raises an error when one of them is missing."""
    held = regions.where(F.col("region").isin(*isos))
    n = held.agg(F.count_distinct("region").alias("n")).withColumn("ok", F.when(F.col("n") == len(set(isos)), True).otherwise(F.raise_error(F.lit("regions are missing"))))
    return held.crossJoin(n.select("ok")).where("ok").drop("ok")  # one row


def newest_path(listing: DataFrame, pattern: str = r"data-[^,\s\"]+\.csv") -> DataFrame:
    """(path): the last path, by name, that a dataset's index (property, value) mentions; null when there is none."""
    found = listing.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 0)).alias("path"))
    return found.agg(F.max("path").alias("path"))


REGIONS_SCHEMA = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def boundaries(spark: SparkSession, path: str, key: str = "iso", label: str = "name") -> DataFrame:
    """A GeoJSON file of polygons -> region, name, ord, polygons (arrays of rings of lon, lat). Other geometries are left out."""
    raw = spark.read.schema(REGIONS_SCHEMA).option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("ord", "f")).select("ord", F.col("f.properties")[key].alias("region"), F.col("f.properties")[label].alias("name"), "f.geometry.type", "f.geometry.coordinates")
    many = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", _POLYGON))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", _MULTI))
    rings = F.transform(many, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))
    return f.select("region", "name", "ord", rings.alias("polygons")).where("polygons IS NOT NULL AND region IS NOT NULL")


ARCHIVE_SCHEMA = "version string, generatedAt string, years array<int>, regions map<string, struct<name: string, areaKm2: double, years: map<string, struct<vegetation: long, static: long, offshore: long, frpVegetation: double>>>>"


def archive_json(spark: SparkSession, path: str) -> DataFrame:
    """A published archive -> region, name, area_km2, year, vegetation, static, offshore, frp_vegetation. A year that isn't there has no row."""
    raw = spark.read.schema(ARCHIVE_SCHEMA).option("multiLine", True).json(path)
    r = raw.select(F.explode("regions").alias("region", "r")).select("region", "r.name", F.col("r.areaKm2").alias("area_km2"), F.explode("r.years").alias("year", "y"))
    return r.select("region", "name", "area_km2", F.col("year").try_cast("int").alias("year"), "y.vegetation", "y.static", "y.offshore", F.col("y.frpVegetation").alias("frp_vegetation"))


def static_cells_json(spark: SparkSession, path: str) -> DataFrame:
    """A published list of static cells -> version, row, col; a list on another grid is refused."""
    raw = spark.read.schema("version int, gridDeg double, cells array<array<long>>").option("multiLine", True).json(path)
    checked = raw.withColumn("cells", F.when(F.col("gridDeg") == 0.004, F.col("cells")).otherwise(F.raise_error(F.lit("the list has another grid"))))
    return checked.select("version", F.explode("cells").alias("c")).select("version", F.get("c", F.lit(0)).alias("row"), F.get("c", F.lit(1)).alias("col")).where("row IS NOT NULL AND col IS NOT NULL")


SCENE_SCHEMA = "id string, bbox array<double>, properties struct<datetime: string, platform: string, `eo:cloud_cover`: double, `proj:epsg`: int, `proj:code`: string>, assets map<string, struct<href: string, `raster:bands`: array<struct<scale: double, offset: double>>>>"


def scenes(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """Catalogue items as JSON text -> scene_id, w, s, e, n, acquired_at, platform, cloud_cover, epsg, assets. Items without id, box or time are left out."""
    i = json_rows.select(F.from_json(column, SCENE_SCHEMA).alias("i")).select("i.*")
    p = F.col("properties")
    epsg = F.coalesce(p["proj:epsg"], F.regexp_extract(F.coalesce(p["proj:code"], F.lit("")), r"EPSG:(\d+)", 1).try_cast("int"))
    out = i.select(
        F.col("id").alias("scene_id"), *[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate("wsen")], F.try_to_timestamp(p["datetime"]).alias("acquired_at"), p["platform"].alias("platform"),
        p["eo:cloud_cover"].alias("cloud_cover"), epsg.alias("epsg"), F.transform_values("assets", lambda _, a: F.struct(a["href"].alias("href"), F.get(a["raster:bands"], F.lit(0))["scale"].alias("scale"), F.get(a["raster:bands"], F.lit(0))["offset"].alias("offset"))).alias("assets"),
    )
    return out.where("scene_id IS NOT NULL AND n IS NOT NULL AND acquired_at IS NOT NULL")


MAP_SCHEMA = "elements array<struct<type: string, id: long, tags: map<string, string>, geometry: array<struct<lat: double, lon: double>>, lat: double, lon: double, center: struct<lat: double, lon: double>>>"
# Classes of roads and places, and surfaces of paved roads.
CAR_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential")
PAVED_ROADS = ("motorway", "trunk", "primary")
PAVED_SURFACES = ("asphalt", "concrete", "paved")
PLACES = ("city", "town", "village", "hamlet")


def map_elements(json_rows: DataFrame, column: str = "value") -> DataFrame:
    return json_rows.select(F.explode(F.from_json(column, MAP_SCHEMA)["elements"]).alias("e")).select("e.*")


def roads(elements: DataFrame) -> DataFrame:
    """Elements -> ord (id), name, road class, paved, track, and the segments of their lines (lat1, lon1, lat2, lon2)."""
    kind, surface = F.col("tags")["highway"], F.col("tags")["surface"]
    paved = F.when(surface.isNotNull(), surface.isin(*PAVED_SURFACES)).otherwise(kind.isin(*PAVED_ROADS))
    lines = elements.where(kind.isin(*CAR_ROADS, "track") & (F.size("geometry") > 1)).select(F.col("id").alias("ord"), F.coalesce(F.col("tags")["name:ru"], F.col("tags")["name"]).alias("name"), kind.alias("road"), paved.alias("paved"), (kind == "track").alias("track"), "geometry")
    n = F.size("geometry") - 1
    ends = F.zip_with(F.slice("geometry", F.lit(1), n), F.slice("geometry", F.lit(2), n), lambda a, b: F.struct(a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2")))
    return lines.select("ord", "name", "road", "paved", "track", F.explode(ends).alias("s")).select("ord", "name", "road", "paved", "track", "s.*")


def places(elements: DataFrame) -> DataFrame:
    """Elements -> id, ord, name, place, lat, lon of settlements with a name."""
    name, kind = F.coalesce(F.col("tags")["name:ru"], F.col("tags")["name"]), F.col("tags")["place"]
    out = elements.where(kind.isin(*PLACES)).select("id", F.col("id").alias("ord"), name.alias("name"), kind.alias("place"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"))
    return out.where("name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")

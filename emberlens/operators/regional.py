"""Regional indicators: archive counts, deviations, official statistics by name, loss estimates, the long indicator table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.functions import numeric as N, text as T
from emberlens.operators import spatial
from emberlens.shared import materialize

BASELINE_YEARS = 5
CO2_PER_HA = 148
# Regions pinned to the top of lists.
PINNED = ("RU-BU", "RU-IRK", "RU-ZAB")
# Published yearly loss of the country in ha, and the share of the regions with an estimate.
NATIONAL_LOSS_HA = {
    2001: 3320000, 2002: 3010000, 2003: 3840000, 2004: 3270000, 2005: 3480000, 2006: 3910000, 2007: 3640000, 2008: 3120000,
    2009: 3280000, 2010: 4460000, 2011: 2890000, 2012: 4380000, 2013: 3240000, 2014: 3520000, 2015: 3180000, 2016: 3850000,
    2017: 3410000, 2018: 3760000, 2019: 5910000, 2020: 4730000, 2021: 6490000, 2022: 4160000, 2023: 3950000,
}
LOSS_SHARE = {
    "yakutia": 0.185, "krasnoyarsk": 0.182, "irkutsk": 0.121, "khabarovsk": 0.075, "zabaikalye": 0.058, "amur": 0.052, "buryatia": 0.048,
    "tomsk": 0.038, "komi": 0.047, "arkhangelsk": 0.040, "tyumen": 0.035, "primorye": 0.036, "vologda": 0.030, "karelia": 0.025,
}


# ---- detections of the season
def nrt_cells(points: DataFrame) -> DataFrame:
    """Counts in cells of 0.01 degrees, with the newest day."""
    cell = lambda c: F.round(F.col(c).cast("decimal(9,6)"), 2)
    return points.groupBy(cell("lat").alias("cell_lat"), cell("lon").alias("cell_lon")).agg(F.count(F.lit(1)).alias("n"), F.max(F.to_date("acquired_at")).alias("last_day"))


def counts_by_region(cells: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, n): detections by cell centre; a region without any has 0."""
    numbered = cells.select(F.concat_ws(":", "cell_lat", "cell_lon").alias("id"), F.col("cell_lat").cast("double").alias("lat"), F.col("cell_lon").cast("double").alias("lon"), "n")
    placed = spatial.first_region(numbered, edges).join(numbered.select("id", "n"), "id")
    sums = placed.groupBy("region").agg(F.sum("n").alias("n"))
    return regions.select("region").distinct().join(sums, "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))


# ---- yearly archive
# Types of an archive row.
VEGETATION, VOLCANO, STATIC, OFFSHORE = 0, 1, 2, 3


def archive_counts(rows: DataFrame, regions: DataFrame, years: list[int]) -> DataFrame:
    """(region, year, type, frp) -> a row for every region and year: vegetation, static, offshore, frp of vegetation; zero where there is nothing."""
    kind = F.col("type")
    found = rows.groupBy("region", "year").agg(
        F.count_if(kind == VEGETATION).alias("vegetation"), F.count_if(kind == STATIC).alias("static"), F.count_if(kind == OFFSHORE).alias("offshore"),
        # rounded to six places first, so that the order of summing can't tip a half
        N.js_round(N.js_round(F.coalesce(F.sum(F.when(kind == VEGETATION, F.greatest(F.coalesce("frp", F.lit(0.0)), F.lit(0.0)))), F.lit(0.0)), 6), 1).alias("frp_vegetation"),
    )
    spine = regions.select("region").distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    out = spine.join(found, ["region", "year"], "left")
    return out.select("region", "year", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vegetation", "static", "offshore")], F.coalesce("frp_vegetation", F.lit(0.0)).alias("frp_vegetation"))


def archive_side_counts(rows: DataFrame, years: list[int]) -> DataFrame:
    """Rows that the counts leave out, by reason."""
    return rows.agg(
        F.count_if(F.col("region").isNull()).alias("outside_regions"), F.count_if(~F.col("year").isin(*years)).alias("outside_years"),
        F.count_if(F.col("type") == VOLCANO).alias("volcano"), F.count_if(~F.col("type").isin(VEGETATION, VOLCANO, STATIC, OFFSHORE)).alias("other"),
    )


def archive_static_cells(rows: DataFrame, since_year: int) -> DataFrame:
    """Distinct heat cells of static sources from a year on."""
    cells = rows.where((F.col("type") == STATIC) & (F.col("year") >= since_year)).withColumn("row", N.heat_row("lat")).withColumn("col", N.heat_col("row", "lon"))
    return cells.select("row", "col").distinct()


def archive_problems(counts: DataFrame, expected_regions: int) -> DataFrame:
    """(problem): why an archive must not be published: too few regions, a year without any detection."""
    regions = counts.agg(F.count_distinct("region").alias("n")).where(F.col("n") != expected_regions).select(F.format_string("%d regions", "n").alias("problem"))
    empty = counts.groupBy("year").agg(F.sum("vegetation").alias("n")).where("n = 0").select(F.format_string("year %d is empty", "year").alias("problem"))
    return regions.union(empty)


def complete_years(counts: DataFrame, generated_year: int) -> DataFrame:
    return counts.where(F.col("year") < generated_year)


def deviation(series: DataFrame, years: int = BASELINE_YEARS) -> DataFrame:
    """(region, year, value) -> value's deviation in percent from the mean of the ``years`` before, null with a reason when a year is missing or the mean is 0."""
    before = W.partitionBy("region").orderBy("year").rangeBetween(-years, -1)
    out = series.withColumn("n", F.count("value").over(before)).withColumn("mean", F.sum("value").over(before) / float(years))
    ok = (F.col("n") == years) & F.col("value").isNotNull()
    pct = F.when(ok & (F.col("mean") != 0), N.js_round((F.col("value") - F.col("mean")) / F.nullif(F.col("mean"), F.lit(0.0)) * 100.0, 1))
    reason = F.when(F.col("value").isNull(), "no value").when(F.col("n") < years, "years missing").when(F.col("mean") == 0, "mean is zero")
    return out.select("region", "year", "value", F.when(ok, F.col("mean")).alias("baseline"), pct.alias("deviation_pct"), reason.alias("reason"))


def density_series(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, year, vegetation, per_10k): counts per 10,000 square km."""
    return counts.join(regions.select("region", "area_km2"), "region").select("region", "year", "vegetation", N.js_round(N.per_area("vegetation", "area_km2"), 2).alias("per_10k"))


# ---- official statistics
def classify_names(rows: DataFrame, aliases: DataFrame, excluded: DataFrame, patterns: list[tuple[str, str]], name: str = "name") -> DataFrame:
    """Rows with kind ('region' | 'excluded' | 'unmapped'), iso and reason of the name.

    Four spellings of the normalized name are tried: as it is, without a city prefix, without brackets, without both. Exclusions (by
    spelling, then by pattern) come before regions. ``aliases`` (alias, iso) and ``excluded`` (alias, reason) hold normalized spellings.
    """
    distinct = rows.select(F.col(name).alias("raw")).distinct().withColumn("plain", T.normalize_region_name("raw"))
    asked = distinct.select("raw", "plain", F.posexplode(spellings("plain")).alias("rank", "alias"))
    hit = asked.join(excluded, "alias", "left").join(aliases, "alias", "left")
    best = hit.groupBy("raw", "plain").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("rank"))).alias("reason"), F.min_by("iso", F.when(F.col("iso").isNotNull(), F.col("rank"))).alias("iso"))
    by_pattern = reduce(lambda acc, pr: acc.when(F.col("plain").rlike(pr[0]), pr[1]), patterns, F.when(F.col("plain") == "", "empty name"))
    reason = F.coalesce("reason", by_pattern)
    named = best.select("raw", F.when(reason.isNotNull(), "excluded").when(F.col("iso").isNotNull(), "region").otherwise("unmapped").alias("kind"), F.when(reason.isNull(), F.col("iso")).alias("iso"), reason.alias("reason"))
    return rows.join(named, rows[name].eqNullSafe(named["raw"])).drop("raw")


def spellings(plain: str) -> Column:
    p = F.col(plain)
    return F.array_distinct(F.array(p, T.strip_city_prefix(p), T.strip_parens(p), T.strip_parens(T.strip_city_prefix(p))))


def newest_values(rows: DataFrame) -> DataFrame:
    """(iso, value, year, ord) -> iso, value, year: the newest year with a value, without years the first row with one; null when there is none."""
    has = F.col("value").isNotNull()
    rank = F.struct(has.alias("has"), F.coalesce("year", F.lit(-1)).alias("year"), (-F.col("ord")).alias("ord"))
    best = rows.groupBy("iso").agg(F.max_by(F.struct("value", "year"), rank).alias("best"))
    return best.select("iso", "best.value", "best.year")


# ---- loss
def national_loss(spark) -> DataFrame:
    return spark.createDataFrame(list(NATIONAL_LOSS_HA.items()), "year int, area_ha long")


def loss_estimates(national: DataFrame, shares: DataFrame) -> DataFrame:
    """(code, year, area_ha, emissions): a region's share of the national loss, and 148 t of CO2 a hectare."""
    area = N.js_round(F.col("area_ha") * F.col("share"))
    both = national.crossJoin(shares)  # years x regions with an estimate: as many rows as the result
    return both.select("code", "year", area.alias("area_ha"), N.js_round(area * float(CO2_PER_HA)).alias("emissions"))


def loss_by_year(rows: DataFrame, region, first: int, last: int, threshold: int = 30) -> DataFrame:
    """Sums by year of one region's loss rows (region, threshold, year, area, emissions)."""
    asked = rows.where((F.col("region") == region) & (F.col("threshold") == threshold) & F.col("year").between(first, last))
    return asked.groupBy("year").agg(F.sum("area").alias("area_ha"), F.sum("emissions").alias("emissions")).orderBy("year")


def loss_kpis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """total, mean, peak_year (ties: the first) and emissions of loss rows."""
    peak = F.max_by("year", F.struct("area_ha", (-F.col("year")).alias("y")))
    return rows.groupBy(*keys).agg(F.sum("area_ha").alias("total"), N.js_round(F.avg("area_ha")).alias("mean"), peak.alias("peak_year"), F.sum("emissions").alias("emissions"))


# ---- indicators
def indicators(regions: DataFrame, sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """regions (region, name, ...) x {id: (values (region, value, period), unit, kind)} -> the long table: one row for each region and indicator.

    A region missing in a source and a null value both give a null value with a reason, never 0.
    """
    parts = []
    for name, (values, unit, kind) in sources.items():
        v = values.select("region", F.col("value").cast("double").alias("value"), F.col("period").cast("string").alias("period"), F.lit(True).alias("listed"))
        j = regions.select("region", "name").join(v, "region", "left")
        reason = F.when(F.col("listed").isNull(), "region not in source").when(F.col("value").isNull(), "no value in source")
        parts.append(j.select("region", "name", F.lit(name).alias("indicator"), "value", F.lit(unit).alias("unit"), F.lit(kind).alias("kind"), "period", reason.alias("reason")))
    return reduce(DataFrame.union, parts)


#: Columns of the regions' export, in their order.
EXPORT_COLUMNS = ("region", "name", "pinned", "indicator", "label", "value", "unit", "period", "kind", "approximate", "source", "reason")


def export_rows(table: DataFrame, registry: DataFrame, pinned: tuple = PINNED) -> DataFrame:
    """The long table with its registry (indicator, place, label, source, approximate) -> EXPORT_COLUMNS: one row for each region and indicator; a missing value stays null and has its reason beside it, a
    value has none. Indicators without a registry row are left out."""
    j = table.join(registry.select("indicator", "label", "source", F.coalesce("approximate", F.lit(False)).alias("approximate")), "indicator")
    out = j.withColumns({"pinned": F.col("region").isin(*pinned), "reason": F.when(F.col("value").isNull(), F.col("reason"))})
    return out.select(*EXPORT_COLUMNS)


def export_metadata(rows: DataFrame, sources: DataFrame, built_at: Column, files: dict[str, str], errors: DataFrame) -> DataFrame:
    """One row that goes with the regions' export: dataset, built_at, count, region_count, sources (array of structs, by source), files, methods, source_errors (array, in order).

    ``sources``: a row for each source (as by ``status.provenance``); ``errors``: (error) of the sources that failed."""
    n = rows.agg(F.count(F.lit(1)).alias("count"), F.count_distinct("region").alias("region_count"))
    named = sources.agg(F.array_sort(F.collect_list(F.struct(*["source", *[c for c in sources.columns if c != "source"]]))).alias("sources"))
    wrong = errors.agg(F.array_sort(F.collect_list("error")).alias("source_errors"))
    listed = F.create_map(*[F.lit(x) for kv in sorted(files.items()) for x in kv]) if files else F.create_map().cast("map<string, string>")
    methods = F.struct(F.lit(N.PER_AREA_KM2).alias("density_per_km2"), F.lit(BASELINE_YEARS).alias("baseline_years"), F.lit(len(LOSS_SHARE)).alias("estimated_regions"))
    return n.crossJoin(named).crossJoin(wrong).select(F.lit("regions").alias("dataset"), built_at.alias("built_at"), "count", "region_count", "sources", listed.alias("files"), methods.alias("methods"), "source_errors")  # one row each


def column_kind(table: DataFrame) -> DataFrame:
    """(indicator, kind): the kind all regions share, null when they differ."""
    return table.groupBy("indicator").agg(F.count_distinct("kind").alias("n"), F.min("kind").alias("kind")).select("indicator", F.when(F.col("n") == 1, F.col("kind")).alias("kind"))


def pinned_order(iso, pinned: tuple = PINNED) -> Column:
    """Position of a pinned region; the others after them."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in pinned]), iso), F.lit(0)), F.lit(len(pinned) + 1))


def region_order(by: str | None = None, descending: bool = False, iso: str = "region", pinned: tuple = PINNED) -> list[Column]:
    """Pinned regions first, then by a value (nulls last either way) and name in the order of the Russian alphabet, or by name alone."""
    keys = [pinned_order(F.col(iso), pinned)]
    if by:
        keys.append(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last())
    return [*keys, F.collate("name", "ru")]


def sort_regions(table: DataFrame, by: str | None = None, descending: bool = False, iso: str = "region") -> DataFrame:
    return table.orderBy(*region_order(by, descending, iso))


def archive_from_points(rows: DataFrame, edges: DataFrame, regions: DataFrame, years: list[int]) -> DataFrame:
    """Archive rows by coordinates (lat, lon, year, type, frp, malformed) -> archive_counts. Each row counts in the first region that contains it.

    Rows of other years and malformed ones don't reach the join; the rest is written with a number for each row and meets polygons through cells, so rows
    far from every region meet none.
    """
    used = rows.where(~F.col("malformed") & F.col("year").isin(*years) & F.col("type").isin(VEGETATION, STATIC, OFFSHORE))
    numbered = materialize(used.select("lat", "lon", "year", "type", "frp").withColumn("id", F.monotonically_increasing_id()), "archive-rows")
    return archive_counts(spatial.first_region(numbered, edges, ["year", "type", "frp"]), regions, years)


# Kinds of indicators in the order of a report, and how texts name the sources that it cites.
KINDS = ("official", "satellite", "estimate")
CITED = (("rosleshoz", "(?i)Рослесхоз"), ("firms", "(?i)FIRMS"), ("gfw", r"(?i)Global Forest Watch|Hansen|\bGFW\b"), ("osm", r"(?i)OpenStreetMap|\bOSM\b"))


def report_groups(table: DataFrame) -> DataFrame:
    """The long table with ``place``: the position of its kind in a report; kinds that a report doesn't show are left out."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return table.where(F.col("kind").isin(*KINDS)).withColumn("place", place.cast("int"))


def report_sources(table: DataFrame, text: str = "source") -> DataFrame:
    """(region, source id, place): the sources that a region's rows cite, in order; the map that gives the areas always."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(pattern), F.struct(F.lit(i).alias("place"), F.lit(name).alias("cited"))) for i, (name, pattern) in enumerate(CITED)]), lambda x: x.isNotNull())
    always = F.array(F.struct(F.lit(len(CITED) - 1).alias("place"), F.lit("osm").alias("cited")))
    found = table.select("region", F.explode(F.concat(hits, always)).alias("c")).select("region", "c.cited", "c.place")
    return found.distinct()


def latest_loss(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Loss rows (code, year, area_ha) x codes (code, iso) -> (iso, year, area_ha): the newest year of each region on the map of codes."""
    best = rows.where("area_ha IS NOT NULL").groupBy("code").agg(F.max_by(F.struct("year", "area_ha"), "year").alias("best"))
    return codes.join(best, "code").select("iso", "best.year", "best.area_ha")


def newest_day(cells: DataFrame) -> DataFrame:
    """(last_day): the newest day over all cells of the season."""
    return cells.agg(F.max("last_day").alias("last_day"))

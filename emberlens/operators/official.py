"""Official tables of forest statistics as typed rows, and their summary. Here a value that can't be read is 0, unlike in the indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Datasets, the columns of their keys and values under their known spellings, and names of the values.
TABLES = {
    "wood_volume": {"key": ("region", ("region",)), "values": {"volume_thousand_m3": ("volume",)}},
    "forestland": {"key": ("subject", ("subjects", "subject")), "values": {"area_thousand_ha": ("area",)}},
    "forest_fund": {
        "key": ("region", ("region",)),
        "values": {"total_thousand_ha": ("total_materials", "total"), "operational_thousand_ha": ("operational",), "protective_thousand_ha": ("protective",), "protected_thousand_ha": ("protected",), "woodiness_percent": ("woodiness",)},
    },
    "fires": {"key": ("name", ("name",)), "values": {"events": ("number2023", "value")}},
    "fires_area": {"key": None, "values": {"area_thousand_ha": ("area",)}},
    "reforestation": {"key": None, "values": {"year": ("year",), "area_thousand_ha": ("area",)}},
}
# Parts of names, in lower case, of rows that are totals.
WOOD_TOTALS, LAND_TOTALS = ("российская федерация", "всего по"), ("всего", "российская федерация")
FIRST_YEAR = 2001


def number_or_zero(text: Column) -> Column:
    """The number that a text begins with, 0 where it begins with none."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("0")), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def typed(df: DataFrame, dataset: str) -> DataFrame:
    """A table of texts (ord, the row's place in its file, and its columns) -> ord, key and values. Rows with an empty key, and years before 2001, are left out."""
    spec = TABLES[dataset]
    pick = lambda names: F.coalesce(*[F.col(c) for c in names if c in df.columns], F.lit(None).cast("string"))
    values = [number_or_zero(pick(names)).cast("int" if name == "year" else "double").alias(name) for name, names in spec["values"].items()]
    if spec["key"] is None:
        out = df.select("ord", *values)
        return out.where(F.col("year") >= FIRST_YEAR) if "year" in spec["values"] else out
    name, names = spec["key"]
    missing = F.lit("unknown") if dataset == "fires" else F.lit("")
    return df.select("ord", F.coalesce(pick(names), missing).alias(name), *values).where(F.col(name) != "")


def is_total(name: str, parts: tuple) -> Column:
    text = F.lower(F.col(name))
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def without_totals(wood: DataFrame) -> DataFrame:
    """The regions' own rows of the wood volume."""
    return wood.where(~is_total("region", LAND_TOTALS))


def summary(wood: DataFrame, land: DataFrame, reforestation: DataFrame, fires_area: DataFrame) -> DataFrame:
    """Typed tables -> one row: wood_volume and forestland (the first total row of each, else 0), the latest reforested year and its area (of equal years the last row), fires_area (the first row)."""
    first = lambda df, value, name: df.agg(F.coalesce(F.min_by(value, "ord"), F.lit(0.0)).alias(name))
    parts = [
        first(wood.where(is_total("region", WOOD_TOTALS)), "volume_thousand_m3", "wood_volume"), first(land.where(is_total("subject", LAND_TOTALS)), "area_thousand_ha", "forestland"),
        reforestation.agg(F.max("year").alias("reforested_year"), F.max_by("area_thousand_ha", F.struct("year", "ord")).alias("reforested_area")), first(fires_area, "area_thousand_ha", "fires_area"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out

"""Protected areas: which belong to the monitored country, by place and by the script of their name, and their tagged area."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberlens.functions.numeric import in_range, num

# Scripts as ranges of code points, for the names' regular expressions.
CYRILLIC, GEORGIAN, ARMENIAN = r"[Ѐ-ӿ]", r"[Ⴀ-ჿ]", r"[԰-֏]"
# The country's outer bounds in degrees, and the belts in which names or places decide.
SOUTH, NORTH, WEST, EAST = 41.0, 82.0, 19.0, 180.0
CAUCASUS_NORTH, CAUCASUS_WEST, CAUCASUS_EAST = 44.0, 37.0, 51.0
NORDIC_SOUTH, NORDIC_EAST = 68.0, 26.0
NAMED_SOUTH_OF, NAMED_WEST_OF, NAMED_WEST_TO = 50.0, 37.0, 60.0


def has_script(name, script: str) -> Column:
    return F.coalesce(num(name).rlike(script), F.lit(False))


def likely_inside(lat, lon, name, name_ru) -> Column:
    """Whether a protected area is likely one of the country's. Null places aren't; null names are empty.

    Names in neighbours' scripts rule it out, and so do the south of the Caucasus and the Nordic corner. In the southern belt, and in the west
    up to 60 degrees, it takes a Cyrillic name.
    """
    lat, lon = num(lat), num(lon)
    cyrillic = has_script(name, CYRILLIC) | has_script(name_ru, CYRILLIC)
    foreign = has_script(name, GEORGIAN) | has_script(name, ARMENIAN)
    caucasus = (lat < CAUCASUS_NORTH) & lon.between(CAUCASUS_WEST, CAUCASUS_EAST)
    nordic = (lat > NORDIC_SOUTH) & (lon < NORDIC_EAST)
    needs_name = (lat < NAMED_SOUTH_OF) | ((lat < NAMED_WEST_TO) & (lon < NAMED_WEST_OF))
    inside = in_range(lat, SOUTH, NORTH) & in_range(lon, WEST, EAST)
    return F.coalesce(inside & ~foreign & ~caucasus & ~nordic & (cyrillic | ~needs_name), F.lit(False))


def tagged_area_ha(raw) -> Column:
    """The leading number of a tag, where it is above 0."""
    value = F.regexp_extract(F.coalesce(num(raw), F.lit("")), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
    return F.when((value > 0) & (value < float("inf")), value)


def area_features(tags="tags", lat="lat", lon="lon", computed_ha="computed_ha") -> list[Column]:
    """Columns of a protected area from its tags (a map), label point and computed area: name, class, links, area."""
    t = lambda k: F.nullif(F.element_at(num(tags), F.lit(k)), F.lit(""))
    return [
        F.coalesce(t("name:ru"), t("name"), F.lit("Без названия")).alias("name"), t("name:ru").alias("name_ru"), t("protect_class").alias("protect_class"), t("boundary").alias("boundary"),
        num(lat).alias("lat"), num(lon).alias("lon"), t("wikidata").alias("wikidata"), F.coalesce(t("website"), t("url")).alias("website"),
        F.coalesce(tagged_area_ha(F.element_at(num(tags), F.lit("area:ha"))), num(computed_ha)).alias("area_ha"),
    ]

"""Spectral indices and pixel rules as column expressions.

Two families: pixel indices give a struct (value, classification, healthy) with 0 and 'no_data' where they can't be computed; normalized
differences of a scene give null there.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberlens.functions.numeric import js_round, num

# Upper bounds (exclusive) and class names of the indices; the last class has no bound.
CLASSES = {
    "ndvi": [(-0.1, "water"), (0.1, "bare_soil"), (0.2, "sparse_vegetation"), (0.4, "moderate_vegetation"), (0.6, "dense_vegetation"), (None, "very_dense_vegetation")],
    "nbr": [(-0.25, "high_severity_burn"), (-0.1, "moderate_severity_burn"), (0.1, "low_severity_burn"), (0.27, "unburned"), (None, "enhanced_regrowth")],
    "ndwi": [(-0.3, "very_dry"), (0.0, "dry"), (0.2, "moderate_moisture"), (0.4, "wet"), (None, "water")],
    "evi": [(0.1, "no_vegetation"), (0.2, "sparse_vegetation"), (0.4, "moderate_vegetation"), (0.6, "dense_vegetation"), (None, "very_dense_vegetation")],
    "savi": [(0.1, "bare_soil"), (0.2, "sparse_vegetation"), (0.4, "moderate_vegetation"), (0.6, "dense_vegetation"), (None, "very_dense_vegetation")],
    "ndmi": [(-0.3, "severely_stressed"), (0.0, "moderately_stressed"), (0.2, "slightly_stressed"), (0.4, "healthy"), (None, "very_healthy")],
    "dnbr": [
        (-0.25, "enhanced_regrowth_high"), (-0.1, "enhanced_regrowth_low"), (0.1, "unburned"), (0.27, "low_severity"), (0.44, "moderate_low_severity"),
        (0.66, "moderate_high_severity"), (None, "high_severity"),
    ],
    "severity": [(0.1, "unburned"), (0.27, "low"), (0.44, "moderate_low"), (0.66, "moderate_high"), (None, "high")],
}
# Band names of the two sensors.
SENTINEL2 = {"blue": "B02", "green": "B03", "red": "B04", "nir": "B08", "swir1": "B11", "swir2": "B12"}
LANDSAT = {"blue": "B2", "green": "B3", "red": "B4", "nir": "B5", "swir1": "B6", "swir2": "B7"}
# Scene classes that aren't clear land, and classes of a scene's mask.
UNCLEAR_SCL = (0, 1, 3, 8, 9, 10, 11)
CLOUD_SCL, SHADOW_SCL, SNOW_SCL, SATURATED_SCL, NODATA_SCL = (8, 9, 10), 3, 11, 1, 0


def bands(mapping: dict[str, str]) -> list[Column]:
    return [F.col(source).alias(name) for name, source in mapping.items()]


def classify(value: Column, index: str) -> Column:
    """The class whose bound is the first above the value. A search in an array, as a ladder for each of several indices makes one method too long to be compiled."""
    bounds, names = zip(*CLASSES[index], strict=True)
    passed = F.filter(F.array(*[F.lit(b) for b in bounds[:-1]]), lambda b: b <= value)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.size(passed) + 1)


def _result(value: Column, index: str, healthy, ok: Column) -> Column:
    """value, classification, healthy. The value is null at first where it can't be computed, so that each field begins with the same expression, which Spark computes once."""
    v = F.when(F.coalesce(ok, F.lit(False)), value)
    return F.struct(
        F.coalesce(js_round(v, 4), F.lit(0.0)).alias("value"), F.when(v.isNull(), "no_data").otherwise(classify(v, index)).alias("classification"), F.coalesce(healthy(v), F.lit(False)).alias("healthy")
    )


def _ratio(a: Column, b: Column) -> tuple[Column, Column]:
    total = a + b
    return (a - b) / F.nullif(total, F.lit(0.0)), total != 0


def ndvi(nir, red) -> Column:
    v, ok = _ratio(num(nir), num(red))
    return _result(v, "ndvi", lambda v: v >= 0.4, ok)


def nbr(nir, swir2) -> Column:
    v, ok = _ratio(num(nir), num(swir2))
    return _result(v, "nbr", lambda v: v >= 0.2, ok & (num(swir2) != 0))


def ndwi(green, nir) -> Column:
    v, ok = _ratio(num(green), num(nir))
    return _result(v, "ndwi", lambda v: (v >= -0.3) & (v <= 0.3), ok & (num(green) != 0))


def ndmi(nir, swir1) -> Column:
    v, ok = _ratio(num(nir), num(swir1))
    return _result(v, "ndmi", lambda v: v >= 0.0, ok & (num(swir1) != 0))


def evi(blue, red, nir) -> Column:
    below = num(nir) + num(red) * 6.0 - num(blue) * 7.5 + 1.0
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (num(nir) - num(red)) / F.nullif(below, F.lit(0.0)) * 2.5))
    return _result(v, "evi", lambda v: v >= 0.3, (num(blue) != 0) & (below != 0))


def savi(nir, red, soil: float = 0.5) -> Column:
    below = num(nir) + num(red) + soil
    v = (num(nir) - num(red)) / F.nullif(below, F.lit(0.0)) * (1.0 + soil)
    return _result(v, "savi", lambda v: v >= 0.3, below != 0)


def dnbr(before, after) -> Column:
    v = num(before) - num(after)
    return _result(v, "dnbr", lambda v: v < 0.1, v.isNotNull())


def severity(dnbr_value) -> Column:
    return F.when(num(dnbr_value).isNotNull(), classify(num(dnbr_value), "severity"))


# ---- scenes
def reflectance(dn, scale: float = 0.0001, offset: float = -0.1) -> Column:
    """Digital number to reflectance; 0 is no data."""
    return F.when(num(dn) != 0, num(dn) * scale + offset)


def normalized_difference(a, b) -> Column:
    """(a - b) / (a + b) from -1 to 1; null where the sum isn't positive."""
    a, b = num(a), num(b)
    return F.when(a + b > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a - b) / F.nullif(a + b, F.lit(0.0)))))


def is_clear(scl) -> Column:
    return ~num(scl).isin(*UNCLEAR_SCL)


# ---- pictures
# The five stops of the vegetation palette, from -0.2 to 0.9.
NDVI_LOW, NDVI_HIGH = -0.2, 0.9
NDVI_STOPS = ((165, 0, 38), (244, 109, 67), (255, 255, 191), (102, 189, 99), (0, 104, 55))


def ndvi_color(value) -> Column:
    """[r, g, b] between the palette's stops."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (num(value) - NDVI_LOW) / (NDVI_HIGH - NDVI_LOW))) * float(len(NDVI_STOPS) - 1)
    i = F.least(F.floor(t), F.lit(len(NDVI_STOPS) - 2)).cast("int")
    stop = lambda k, c: F.element_at(F.array(*[F.lit(float(s[c])) for s in NDVI_STOPS]), k + 1)
    return F.array(*[js_round(stop(i, c) + (stop(i + 1, c) - stop(i, c)) * (t - i)).cast("int") for c in range(3)])


# The brightest reflectance of a short-wave picture and its gamma.
SWIR_BRIGHTEST, SWIR_GAMMA = 0.4, 1.4


def stretch_swir(dn, scale: float = 0.0001, offset: float = -0.1) -> Column:
    """A band's number as a byte of a short-wave picture."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (num(dn) * scale + offset) / SWIR_BRIGHTEST))
    return js_round(F.pow(t, F.lit(1 / SWIR_GAMMA)) * 255.0).cast("int")


def rgba(numbers: list[Column], channels: list[Column], empty: str = "any") -> Column:
    """[r, g, b, 255], or four zeros where ``empty`` ('any' or 'all') of the bands' numbers are 0 or null."""
    none = [F.coalesce(num(x) == 0, F.lit(True)) for x in numbers]
    out = none[0]
    for x in none[1:]:
        out = (out | x) if empty == "any" else (out & x)
    return F.when(out, F.array(*[F.lit(0)] * 4)).otherwise(F.array(*[c.cast("int") for c in channels], F.lit(255)))


def swir_rgba(b12, b8a, b04, scale: float = 0.0001, offset: float = -0.1) -> Column:
    return rgba([b12, b8a, b04], [stretch_swir(b, scale, offset) for b in (b12, b8a, b04)])


def ndvi_rgba(red, nir, scl, scale: float = 0.0001, offset: float = -0.1) -> Column:
    """The palette's colour of a pixel; four zeros where it isn't clear or has no index."""
    v = normalized_difference(reflectance(nir, scale, offset), reflectance(red, scale, offset))
    return F.when(is_clear(scl) & v.isNotNull(), F.concat(ndvi_color(v), F.array(F.lit(255)))).otherwise(F.array(*[F.lit(0)] * 4))


def decode_disturbance(red, green, blue) -> Column:
    """Days since the first day and the confidence that an alert tile's pixel encodes."""
    r, g, b = (num(x).cast("int") for x in (red, green, blue))
    return F.struct((r * 255 + g).alias("days"), F.floor(b / 100).cast("int").alias("confidence"))


def decode_loss(red, blue, zoom: int) -> Column:
    """Year offset (blue) and intensity (red, stronger at low zoom) of a loss tile's pixel; null where there is none."""
    strength = F.least(F.lit(255.0), num(red) * (1.0 + max(0, 12 - zoom) * 0.1))
    return F.when(num(blue) > 0, F.struct(num(blue).cast("int").alias("year_offset"), js_round(strength).cast("int").alias("alpha")))

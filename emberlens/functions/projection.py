"""Map projection and picture grids as column expressions: UTM by the Krüger series, output grids, overview levels, pixel windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from emberlens.functions.numeric import num, radians

# The WGS84 ellipsoid and the transverse Mercator zones on it.
SEMI_AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST_M, FALSE_NORTH_M = 0.9996, 500_000.0, 10_000_000.0
#: Longest side of a picture in pixels and the finest pixel in metres.
MOST_PIXELS, LEAST_PIXEL_M = 512, 10.0

_N = FLATTENING / (2 - FLATTENING)
RADIUS_M = SEMI_AXIS_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
#: Coefficients of the series to the fourth power of the third flattening.
SERIES = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)


def is_utm(epsg) -> Column:
    """Whether a code is one of the zones: 32601 to 32660 in the north, 32701 to 32760 in the south."""
    code = num(epsg)
    return F.coalesce(code.between(32601, 32660) | code.between(32701, 32760), F.lit(False))


def utm(lat, lon, epsg) -> Column:
    """struct(x, y) in metres in the zone that ``epsg`` names; null for any other code."""
    code = num(epsg)
    centre = (code % 100) * 6.0 - 183.0
    sine = F.sin(radians(lat))
    t = F.sinh(F.atanh(sine) - F.atanh(sine * ECCENTRICITY) * ECCENTRICITY)
    turn = radians(num(lon) - centre)
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(t * t + 1.0))
    east, north = eta, xi
    for j, c in enumerate(SERIES, 1):
        east = east + F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * c
        north = north + F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * c
    south = F.when(code >= 32700, F.lit(FALSE_NORTH_M)).otherwise(F.lit(0.0))
    return F.when(is_utm(epsg), F.struct((east * (SCALE * RADIUS_M) + FALSE_EAST_M).alias("x"), (north * (SCALE * RADIUS_M) + south).alias("y")))


def plan_grid(box: Column, most: int = MOST_PIXELS, least_m: float = LEAST_PIXEL_M) -> Column:
    """struct(w, s, e, n, width, height, pixel): square pixels over a box of metres, grown about its centre to whole pixels."""
    wide, high = box["e"] - box["w"], box["n"] - box["s"]
    pixel = F.greatest(F.lit(float(least_m)), F.greatest(wide, high) / float(most))
    count = lambda side: F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(side / pixel - 1e-9).cast("int")))
    width, height = count(wide), count(high)
    x, y = (box["w"] + box["e"]) / 2.0, (box["s"] + box["n"]) / 2.0
    dx, dy = width * pixel / 2.0, height * pixel / 2.0
    return F.struct((x - dx).alias("w"), (y - dy).alias("s"), (x + dx).alias("e"), (y + dy).alias("n"), width.alias("width"), height.alias("height"), pixel.alias("pixel"))


def pick_level(resolutions: Column, target) -> Column:
    """Index (from 0) of the coarsest overview that is no coarser than ``target``; 0, full resolution, where that is coarser itself."""
    fine = F.filter(resolutions, lambda r: F.abs(r) <= num(target) + 1e-6)
    coarsest = F.array_max(F.transform(fine, lambda r: F.abs(r)))
    first = F.array_position(F.transform(resolutions, lambda r: F.abs(r)), coarsest) - 1
    return F.when(coarsest > F.abs(F.get(resolutions, F.lit(0))), first).otherwise(F.lit(0)).cast("int")


def pixel_window(box: Column, x0, y0, resolution, width, height) -> Column:
    """struct(x0, y0, x1, y1), ends exclusive: the pixels of an image (upper left corner x0, y0) that cover a box; null where there are none."""
    r = F.abs(num(resolution))
    left = F.greatest(F.lit(0), F.floor((box["w"] - num(x0)) / r))
    right = F.least(num(width), F.ceil((box["e"] - num(x0)) / r))
    top = F.greatest(F.lit(0), F.floor((num(y0) - box["n"]) / r))
    bottom = F.least(num(height), F.ceil((num(y0) - box["s"]) / r))
    inside = (right > left) & (bottom > top)
    return F.when(inside, F.struct(*[v.cast("long").alias(k) for k, v in (("x0", left), ("y0", top), ("x1", right), ("y1", bottom))]))


def grid_pixel(x, y, grid: Column) -> Column:
    """struct(col, row): where a point lies on a grid, in fractions of pixels from its upper left corner."""
    return F.struct(((num(x) - grid["w"]) / grid["pixel"]).alias("col"), ((grid["n"] - num(y)) / grid["pixel"]).alias("row"))

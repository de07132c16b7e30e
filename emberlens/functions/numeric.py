"""Numeric, grid and geodesic column helpers. All are built-in functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Three Earth radii and two lengths of a degree, each used by its own family of results.
EARTH_RADIUS_KM = 6371.0088
PROXIMITY_RADIUS_KM = 6371.0
AREA_RADIUS_KM = 6378.137
KM_PER_DEG = 111.32
KM_PER_DEG_LAT_AOI = 110.574
# Grids.
PIXEL_KM = 0.375
PIXEL_HA = 14.06
HEAT_CELL_DEG = 0.004
NRT_CELL_DEG = 0.01
PER_AREA_KM2 = 10_000


def num(x) -> Column:
    """A Python number as a double literal; a name or column as a column."""
    return F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x


def js_round(x, digits: int = 0) -> Column:
    """Rounds half towards plus infinity on doubles, the same in every engine that has floor()."""
    scale = float(10**digits)
    return F.floor(num(x) * scale + 0.5).cast("double") / scale


def safe_div(a, b) -> Column:
    """a / b, null where b is 0 or either is null."""
    return num(a).cast("double") / F.nullif(num(b).cast("double"), F.lit(0.0))


def in_range(x, low: float, high: float) -> Column:
    return (num(x) >= low) & (num(x) <= high)


# ---- grids
def row_of(lat, cell: float) -> Column:
    return F.floor(num(lat) / cell).cast("long")


def heat_row(lat) -> Column:
    return row_of(lat, HEAT_CELL_DEG)


def heat_col(row, lon) -> Column:
    """Column of a longitude in a row of the 0.004 degree grid; cells are as wide in km as they are high."""
    centre = (num(row) + 0.5) * HEAT_CELL_DEG * math.pi / 180.0
    return F.floor(num(lon) * F.cos(centre) / HEAT_CELL_DEG).cast("long")


def heat_centre(row, col) -> tuple[Column, Column]:
    """Latitude and longitude of a heat cell's centre."""
    lat = (num(row) + 0.5) * HEAT_CELL_DEG
    return lat, (num(col) + 0.5) * HEAT_CELL_DEG / F.cos(lat * math.pi / 180.0)


def pixel_key(lat, lon) -> Column:
    """'row:col' of the 375 m grid."""
    row = F.floor(num(lat) * KM_PER_DEG / PIXEL_KM)
    centre = (row + 0.5) * PIXEL_KM / KM_PER_DEG
    col = F.floor(num(lon) * (F.cos(centre * math.pi / 180.0) * KM_PER_DEG) / PIXEL_KM)
    return F.concat_ws(":", row.cast("long").cast("string"), col.cast("long").cast("string"))


def pixel_area_ha(pixels) -> Column:
    return js_round(num(pixels) * PIXEL_HA, 2)


def grid_key_100(x) -> Column:
    """Hundredths of a degree as a whole number, half up."""
    return F.floor(num(x) * 100.0 + 0.5).cast("long")


# ---- geodesy
def radians(x) -> Column:
    return num(x) * math.pi / 180.0


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    lat1, lon1, lat2, lon2 = map(num, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(radians(lat2 - lat1) / 2.0), F.lit(2.0)) + F.cos(radians(lat1)) * F.cos(radians(lat2)) * F.pow(F.sin(radians(lon2 - lon1) / 2.0), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2.0 * radius)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(radians, (lat1, lon1, lat2, lon2))
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    degrees = F.atan2(y, x) * 180.0 / math.pi
    return F.pmod(degrees + 360.0, F.lit(360.0))


def destination(lat, lon, bearing, km, radius: float = EARTH_RADIUS_KM) -> tuple[Column, Column]:
    """Point reached from (lat, lon) after ``km`` on a great circle."""
    d, b, la, lo = num(km) / radius, radians(bearing), radians(lat), radians(lon)
    sine = F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b)
    out = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))
    east = lo + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(out))
    return out * 180.0 / math.pi, wrap_lon(east * 180.0 / math.pi)


def segment_km(lat, lon, lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Distance from a point to a great-circle segment: cross-track inside, the nearer end outside."""
    d13 = haversine_km(lat1, lon1, lat, lon, radius) / radius
    length = haversine_km(lat1, lon1, lat2, lon2, radius) / radius
    turn = radians(bearing_deg(lat1, lon1, lat, lon)) - radians(bearing_deg(lat1, lon1, lat2, lon2))
    cross = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d13) * F.sin(turn))))
    along = F.atan2(F.sin(d13) * F.cos(turn), F.cos(d13))
    to_first, to_last = d13 * radius, haversine_km(lat2, lon2, lat, lon, radius)
    return F.when((length == 0) | (along <= 0), to_first).when(along >= length, to_last).otherwise(F.abs(cross) * radius)


def lon_delta(a, b) -> Column:
    """a - b on the shorter way round, -180 to 180."""
    return F.pmod(num(a) - num(b) + 540.0, F.lit(360.0)) - 180.0


def wrap_lon(x) -> Column:
    return F.pmod(num(x) + 180.0, F.lit(360.0)) - 180.0


def boundary_km(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Distance from a point to an edge on a local flat projection around the point; longitudes go the shorter way round."""
    k = math.pi / 180.0 * PROXIMITY_RADIUS_KM
    shrink = F.cos(radians(lat))
    ax, ay = lon_delta(lon1, lon) * shrink * k, (num(lat1) - num(lat)) * k
    bx, by = lon_delta(lon2, lon) * shrink * k, (num(lat2) - num(lat)) * k
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(square, F.lit(0.0)))))
    return F.sqrt(F.pow(ax + t * dx, F.lit(2.0)) + F.pow(ay + t * dy, F.lit(2.0)))


def bbox_distance_km(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shortest distance between two boxes with keys s, w, n, e; 0 where they touch."""
    lat_low = F.when(a["s"] > b["n"], b["n"]).when(b["s"] > a["n"], a["n"])
    lat_high = F.when(a["s"] > b["n"], a["s"]).when(b["s"] > a["n"], b["s"])
    lon_low = F.when(a["w"] > b["e"], b["e"]).when(b["w"] > a["e"], a["e"])
    lon_high = F.when(a["w"] > b["e"], a["w"]).when(b["w"] > a["e"], b["w"])
    near = F.when(lat_low.isNotNull(), (lat_low + lat_high) / 2.0).otherwise((F.greatest(a["s"], b["s"]) + F.least(a["n"], b["n"])) / 2.0)
    north = F.when(lat_low.isNull(), F.lit(0.0)).otherwise(haversine_km(lat_low, 0.0, lat_high, 0.0))
    east = F.when(lon_low.isNull(), F.lit(0.0)).otherwise(haversine_km(near, lon_low, near, lon_high))
    return F.sqrt(north * north + east * east)


def in_bbox(lat, lon, west: float, south: float, east: float, north: float) -> Column:
    """Inside a box; east may exceed 180, then negative longitudes count as lon + 360."""
    lon = num(lon)
    shifted = F.when((F.lit(float(east)) > 180.0) & (lon < 0), lon + 360.0).otherwise(lon)
    return in_range(lat, south, north) & (shifted >= float(west)) & (shifted <= float(east))


def valid_bbox(west, south, east, north) -> Column:
    """All four present and in order."""
    w, s, e, n = map(num, (west, south, east, north))
    return F.coalesce((w <= e) & (s <= n), F.lit(False))


def bboxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["w"] <= b["e"]) & (b["w"] <= a["e"]) & (a["s"] <= b["n"]) & (b["s"] <= a["n"])


def expand_aoi(west, south, east, north, factor: float = 1.2, least_km: float = 3.0, most_km: float = 20.0) -> tuple[Column, Column, Column, Column]:
    """A box around the same centre, each side ``factor`` times as long, ``least_km`` at least; where one is over ``most_km``, a square of that. Not rounded."""
    w, s, e, n = map(num, (west, south, east, north))
    lat, lon = (s + n) / 2.0, (w + e) / 2.0
    per_lon = F.cos(radians(lat)) * KM_PER_DEG
    wide = F.greatest(F.lit(least_km), (e - w) * per_lon * factor)
    high = F.greatest(F.lit(least_km), (n - s) * KM_PER_DEG_LAT_AOI * factor)
    over = F.greatest(wide, high) > most_km
    dx = F.when(over, most_km).otherwise(wide) / 2.0 / per_lon
    dy = F.when(over, most_km).otherwise(high) / 2.0 / KM_PER_DEG_LAT_AOI
    return lon - dx, lat - dy, lon + dx, lat + dy


def pad_bbox(west, south, east, north, km: float) -> tuple[Column, Column, Column, Column]:
    """The box grown by ``km`` on each side, measured at its middle latitude, to five decimals."""
    w, s, e, n = map(num, (west, south, east, north))
    dx, dy = F.lit(float(km)) / (F.cos(radians((s + n) / 2.0)) * KM_PER_DEG), km / KM_PER_DEG_LAT_AOI
    return tuple(js_round(x, 5) for x in (w - dx, s - dy, e + dx, n + dy))


def clip_bbox(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """What two boxes that meet have in common."""
    return {"w": F.greatest(a["w"], b["w"]), "s": F.greatest(a["s"], b["s"]), "e": F.least(a["e"], b["e"]), "n": F.least(a["n"], b["n"])}


def cell_area_km2(lat0, step_deg, width_deg) -> Column:
    """Area of a band of latitude from lat0, ``step_deg`` high and ``width_deg`` wide, on a sphere."""
    return radians(width_deg) * (F.sin(radians(num(lat0) + num(step_deg))) - F.sin(radians(lat0))) * (AREA_RADIUS_KM**2)


# ---- indicators
def per_area(count, area_km2, per: float = PER_AREA_KM2) -> Column:
    """Count per ``per`` square km; null without a count or a positive area."""
    return F.when(num(area_km2) > 0, num(count).cast("double") / num(area_km2) * float(per))


def loss_per_100k_ha(loss_ha, fund_thousand_ha) -> Column:
    return F.when(num(fund_thousand_ha) > 0, num(loss_ha) / (num(fund_thousand_ha) * 1000.0) * 100000.0)


def share_percent(part, whole) -> Column:
    """0 to 100; null without a positive whole."""
    part, whole = num(part), num(whole)
    return F.when((whole > 0) & part.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), part / whole * 100.0)))

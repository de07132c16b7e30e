"""Geometry work that needs order along a line: ring assembly, holes, simplification, area. Small per-group helpers; Spark groups the rows.

One relation's ways, or one ring's vertices, meet in one task; both are bounded by what a map editor can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.functions import numeric as N

TOLERANCES = (0.002, 0.004, 0.008, 0.016, 0.032, 0.05)
MOST_VERTICES = 300


def ring_area_km2(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, km2) of rings given as edges: spherical area, sum over edges of (lon2 - lon1) * (2 + sin lat1 + sin lat2) / 2."""
    part = N.radians(N.lon_delta("x2", "x1")) * (F.lit(2.0) + F.sin(N.radians("y1")) + F.sin(N.radians("y2")))
    return edges.groupBy(*keys).agg((F.abs(F.sum(part)) * (N.AREA_RADIUS_KM**2) / 2.0).alias("km2"))


def area_km2(edges: DataFrame) -> DataFrame:
    """(region, km2): outer rings less holes."""
    rings = ring_area_km2(edges, ["region", "polygon", "ring", "hole"])
    return rings.groupBy("region").agg(F.sum(F.when(F.col("hole"), -F.col("km2")).otherwise(F.col("km2"))).alias("km2"))


def ring_problem(points: Column) -> Column:
    """Why a ring (array of lon, lat) is no ring: too few points, not closed, off the globe; null when it is one."""
    off = F.exists(points, lambda p: (F.abs(p["lat"]) > 90) | (F.abs(p["lon"]) > 180) | p["lat"].isNull() | p["lon"].isNull())
    return F.when(F.coalesce(F.size(points), F.lit(0)) < 4, "too few points").when(off, "off the globe").when(F.element_at(points, 1) != F.element_at(points, -1), "not closed")


def _join_ways(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from ways that share end points; what can't be closed is dropped. A ring goes on with the first way left that has its end: ways are looked up by their
    end points, so the work is linear in the ways."""
    ways, rings = [w for w in ways if len(w) > 1], []
    used, at = [False] * len(ways), {}
    for i in range(len(ways) - 1, -1, -1):  # so that the first way stands last
        for end in {ways[i][0], ways[i][-1]}:
            at.setdefault(end, []).append(i)
    for first in range(len(ways)):
        if used[first]:
            continue
        used[first], ring = True, list(ways[first])
        while ring[0] != ring[-1]:
            held = at[ring[-1]]
            while held and used[held[-1]]:
                held.pop()
            if not held:
                break
            k = held.pop()
            used[k] = True
            ring += ways[k][1:] if ways[k][0] == ring[-1] else ways[k][-2::-1]
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def _inside(x: float, y: float, ring: list[tuple[float, float]]) -> bool:
    a = np.array(ring)
    x1, y1, x2, y2 = a[:-1, 0], a[:-1, 1], a[1:, 0], a[1:, 1]
    spans = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return bool((spans & (x < cross)).sum() % 2)


def assemble_rings(ways: DataFrame) -> DataFrame:
    """(relation, ord, role 'outer' | 'inner', points array<struct<lon, lat>>) -> relation, polygon, ring, points: ring 0 is the outer one.

    A hole goes to the first outer ring that has its first vertex inside; a hole without one is dropped.
    """

    def assembled(ways) -> list[dict]:
        lines = {role: [[(p["lon"], p["lat"]) for p in w["points"]] for w in ways if w["role"] == role] for role in ("outer", "inner")}
        polygons = [[ring] for ring in _join_ways(lines["outer"])]
        for hole in _join_ways(lines["inner"]):
            home = next((p for p in polygons if _inside(*hole[0], p[0])), None)
            if home:
                home.append(hole)
        return [{"polygon": i, "ring": j, "points": [{"lon": x, "lat": y} for x, y in ring]} for i, rings in enumerate(polygons) for j, ring in enumerate(rings)]

    @F.pandas_udf("array<struct<polygon: int, ring: int, points: array<struct<lon: double, lat: double>>>>")
    def work(column: pd.Series) -> pd.Series:
        return column.map(assembled)

    held = ways.groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("ord", "role", "points"))).alias("ways"))
    return held.select(F.col("relation").cast("long").alias("relation"), F.explode(work("ways")).alias("r")).select("relation", "r.polygon", "r.ring", "r.points")


def _simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Keeps the ends and, again and again, the vertex farthest from the chord while it is beyond the tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = math.hypot(*chord)
        far = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify_rings(rings: DataFrame, most: int = MOST_VERTICES) -> DataFrame:
    """Rings with at most ``most`` vertices of five decimals: the first tolerance that is enough, else every n-th vertex.

    A ring stays closed and keeps four points at least.
    """

    @F.pandas_udf("array<struct<lon: double, lat: double>>")
    def work(column: pd.Series) -> pd.Series:
        def one(points) -> list[dict]:
            a = np.array([(p["lon"], p["lat"]) for p in points])
            out = a
            for tolerance in TOLERANCES:
                if len(out) <= most:
                    break
                out = _simplify(a, tolerance)
            if len(out) > most:
                out = np.vstack([out[:-1][:: -(-len(out) // (most - 1))], out[-1:]])
            if len(out) < 4:
                out = a
            return [{"lon": round(float(x), 5), "lat": round(float(y), 5)} for x, y in out]

        return column.map(one)

    return rings.withColumn("points", work("points"))


def label_points(edges: DataFrame) -> DataFrame:
    """(region, lon, lat): the middle of the widest stretch that a region's middle latitude row has inside it, so it lies in the region."""
    span = edges.groupBy("region").agg(((F.min(F.least("y1", "y2")) + F.max(F.greatest("y1", "y2"))) / 2.0).alias("lat"))
    hit = edges.join(span, "region").where((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat")))
    order = W.partitionBy("region", "polygon").orderBy("x")
    x = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    spans = hit.withColumn("x", x).withColumn("high", F.lead("x").over(order)).withColumn("n", F.row_number().over(order)).where("n % 2 = 1")
    best = spans.groupBy("region").agg(F.max_by(F.struct(((F.col("x") + F.col("high")) / 2.0).alias("lon"), "lat"), F.struct((F.col("high") - F.col("x")).alias("w"), (-F.col("x")).alias("x"))).alias("p"))
    return best.select("region", "p.lon", "p.lat")

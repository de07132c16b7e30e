"""What lies around an incident: the nearest road, paved road, track and settlement, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlens.functions import numeric as N
from emberlens.operators import spatial
from emberlens.shared import materialize

RADIUS_KM = 15.0


def incident_context(incidents: DataFrame, roads: DataFrame, places: DataFrame, data_date, fetched_at, radius_km: float = RADIUS_KM) -> DataFrame:
    """(id, lat, lon) x road segments (ord, name, paved, track, lat1 ... lon2) x places (id, ord, name, lat, lon) -> a row for each incident.

    id, lat, lon (rounded to three places: distances are from there), and road, paved_road, track, settlement: structs of km and name, null where
    none is within the radius; data_date is the time of the data, or that of the fetch where it is unknown. Incidents without a centre have nulls.
    Ties go to the smaller ord. Spots are looked up, so incidents at one place ask once.
    """
    points = incidents.select("id", N.js_round("lat", 3).alias("lat"), N.js_round("lon", 3).alias("lon"))
    known = materialize(points.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct().withColumn("id", F.struct("lat", "lon")), "spots")
    kinds = {"road": roads.where("NOT track"), "paved_road": roads.where("NOT track AND paved"), "track": roads.where("track")}
    found = known
    for name, some in kinds.items():
        found = found.join(spatial.nearest_segment(known, some, radius_km, ["name"]).select("id", F.struct("km", "name").alias(name)), "id", "left")
    found = found.join(spatial.nearest_point(known, places, radius_km, ["name"]).select("id", F.struct("km", "name").alias("settlement")), "id", "left")
    out = points.join(found.drop("id"), ["lat", "lon"], "left").select("id", "lat", "lon", *kinds, "settlement")
    return out.withColumns({"data_date": F.coalesce(data_date, fetched_at), "radius_km": F.lit(radius_km)})

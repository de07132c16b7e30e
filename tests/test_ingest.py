"""Runs of the incident job, feeds and their gates, the journal, and joins across the antimeridian."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlens.functions import numeric as N
from emberlens.operators import incidents as I, spatial
from emberlens.sources import readers, sinks
from emberlens.streaming import ingest
from tests.test_operators import POINTS, RINGS, T0, km, ring

NOW = dt.datetime(2026, 9, 24, 5)
STORED = "id long, satellite string, acquisition_date date, acquisition_time string, latitude double, longitude double, frp double, confidence string"


def observed(rows):
    return [(i, "N", at.date(), at.strftime("%H:%M:%S"), lat, lon, frp, sure) for i, lat, lon, at, frp, sure in rows]


def points_of(o):
    at = F.to_timestamp(F.concat_ws(" ", "acquisition_date", "acquisition_time"))
    return o.select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), at.alias("acquired_at"), "satellite", "confidence", "frp", F.lit("A").alias("region_iso"), F.lit("a").alias("region"))


def incident(spark, **values):
    base = {
        "incident_id": 1, "cluster_key": "1", "region_iso": "A", "region": "a", "hotspot_count": 2, "high_count": 0, "pixel_count": 1, "frp_max": 1.0, "frp_sum": 2.0, "first_seen": NOW, "last_seen": NOW, "status": "active",
        "max_hotspot_id": 99, "center_lat": 60.0, "center_lng": 100.0, "bbox_min_lat": 60.0, "bbox_min_lng": 100.0, "bbox_max_lat": 60.0, "bbox_max_lng": 100.0, "satellite": "N",
    }
    row = base | values
    return tuple(row[c] for c in I.STATE)


def day(k, hour=5):
    return NOW - dt.timedelta(days=k) + dt.timedelta(hours=hour - 5)


FLARE = (60.0, 100.0)
FLARE_ROWS = [(i, *FLARE, day(k), 5.0, "nominal") for i, k in enumerate((12, 9, 6, 3, 1, 0))]
FIRE_ROWS = [(50 + i, 60.009 + 0.0004 * i, 100.0, day(0), 80.0, "high") for i in range(3)]


def test_a_fire_beside_a_flare_is_an_incident_of_its_own(spark, tmp_path):
    schema = ingest.incident_schema(points_of(spark.createDataFrame([], STORED)))
    old = spark.createDataFrame(
        [
            incident(spark, incident_id=7, first_seen=day(12), last_seen=day(1), max_hotspot_id=5),
            incident(spark, incident_id=8, first_seen=day(40), last_seen=day(40), status="inactive", max_hotspot_id=5),  # too long ago to be looked at
            incident(spark, incident_id=9, first_seen=day(12), last_seen=day(9), status="inactive", max_hotspot_id=5),  # quiet, seen in the window
            incident(spark, incident_id=10, first_seen=day(5), last_seen=day(4), bbox_min_lat=62.0, bbox_max_lat=62.1),  # touched by nothing
            incident(spark, incident_id=11, first_seen=day(0), last_seen=day(0), max_hotspot_id=-1),  # touched, but no observation is its own
        ],
        schema,
    )
    state = sinks.Snapshots(spark, str(tmp_path / "state"))
    state.write(old.where("incident_id <> 11"))
    batch = spark.createDataFrame(observed(FLARE_ROWS + FIRE_ROWS), STORED)
    journal = sinks.Journal(spark, str(tmp_path / "journal"))
    work = ingest.incident_job(str(tmp_path / "observations"), state, points_of)
    job = ingest.journalled("incidents", journal, work)
    (tmp_path / "observations" / "acquisition_date=2026-01-01").mkdir(parents=True)
    (tmp_path / "observations" / "acquisition_date=2026-01-01" / "part-0.parquet").write_text("not to be read")
    job(batch, 0)
    got = {r.incident_id: r for r in state.last_good().collect()}
    assert {k: r.status for k, r in got.items()} == {7: "static_source", 8: "inactive", 9: "static_source", 10: "inactive", 11: "active"}
    assert (got[7].hotspot_count, got[7].frp_max) == (2, 1.0) and (got[11].hotspot_count, got[11].frp_max, got[11].high_count) == (3, 80.0, 3)
    row = journal.rows().first()
    assert (row.job, row.run, row.outcome, row.items, row.written, row.rejected, row.created, row.updated, row.relabelled, row.deactivated, row.masked) == ("incidents", 0, "updated", 9, 9, 0, 1, 0, 2, 1, 3)
    before = sorted(map(tuple, state.last_good().collect()))
    job(batch, 0)
    assert sorted(map(tuple, state.last_good().collect())) == before
    row = journal.rows().collect()
    assert [(r.run, r.written, r.rejected, r.created) for r in row] == [(0, 0, 9, 0)]
    relabels = I.static_relabels(old, points_of(batch), points_of(batch), F.lit(NOW))
    assert {r.incident_id for r in relabels.collect()} == {7, 9}


def test_failures_are_journalled(spark, tmp_path):
    journal = sinks.Journal(spark, str(tmp_path / "journal"))
    assert journal.rows().count() == 0

    def work(batch, batch_id):
        raise ValueError("x" * 999)

    with pytest.raises(ValueError):
        ingest.journalled("j", journal, work)(spark.range(1), 4)
    assert [(r.job, r.run, r.outcome, len(r.error)) for r in journal.rows().collect()] == [("j", 4, "failed", 300)]
    ingest.journalled("j", journal, lambda b, i: {"items": 2, "other": 1})(spark.range(1), 4)
    assert [(r.run, r.outcome, r.items, r.error) for r in journal.rows().collect()] == [(4, "updated", 2, None)]


def test_refresh_and_retention(spark, tmp_path):
    journal, kept = sinks.Journal(spark, str(tmp_path / "journal")), sinks.Snapshots(spark, str(tmp_path / "kept"))
    assert ingest.refresh("feed", 1, journal, kept, lambda: (spark.range(3), 2, {}))
    assert ingest.refresh("feed", 2, journal, kept, lambda: (spark.range(5), 0, {"b": "10 of 20 rows are invalid"}))
    assert not ingest.refresh("feed", 3, journal, kept, lambda: (spark.range(0), 0, {}))
    assert not ingest.refresh("feed", 4, journal, kept, lambda: 1 / 0)
    assert kept.last_good().count() == 5
    got = {r.run: (r.outcome, r.items, r.rejected, r.error) for r in journal.rows().collect()}
    assert got == {1: ("updated", 3, 2, None), 2: ("failed", 5, 0, "quality check: b: 10 of 20 rows are invalid"), 3: ("kept-cached", None, 0, None), 4: ("failed", None, None, "division by zero")}
    path = str(tmp_path / "observations")
    sinks.append_observations(spark.createDataFrame(observed([(i, 1.0, 2.0 + i, day(k), 1.0, "high") for i, k in enumerate((0, 30, 31, 31, 60))]), STORED), path)
    assert ingest.retention(1, journal, spark, path, NOW.date()) == 3 and spark.read.parquet(path).count() == 2
    assert ingest.retention(1, journal, spark, path, NOW.date()) == 0 and journal.rows().where("job = 'retention'").count() == 1
    assert sinks.newest_day(spark, path) == NOW.date() and sinks.newest_day(spark, str(tmp_path / "none")) is None


def test_boxes_touched(spark):
    rng = random.Random(4)
    boxes = [(i, (w := rng.uniform(99, 101)), (s := rng.uniform(59, 61)), w + rng.uniform(0, 0.02), s + rng.uniform(0, 0.02)) for i in range(300)]
    spots = [(rng.uniform(59, 61), rng.uniform(99, 101)) for _ in range(300)] + [(boxes[0][2] - 0.0044, boxes[0][1] - 0.0085), (89.9999, 100.0)]
    pad = 0.5 / N.KM_PER_DEG
    import math

    want = set()
    for i, w, s, e, n in boxes:
        for lat, lon in spots:
            p = pad / max(math.cos(math.radians(lat)), 0.01)
            if s - pad <= lat <= n + pad and w - p <= lon <= e + p:
                want.add(i)
    got = spatial.boxes_touched(spark.createDataFrame(boxes, "box long, west double, south double, east double, north double"), spark.createDataFrame(spots, "lat double, lon double"), 0.5).collect()
    assert sorted(r.box for r in got) == sorted(want) and 0 in want and len(want) < 300


# ---- antimeridian
def test_nearest_across_the_antimeridian(spark):
    p = spark.createDataFrame([(1, 66.5, 179.9), (2, 66.5, -179.95), (3, 66.5, 100.0)], "id long, lat double, lon double")
    roads = spark.createDataFrame([(1, "west", 66.5, -179.95, 66.6, -179.9), (2, "over", 66.45, 179.8, 66.45, -179.8)], "ord long, name string, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.id: (r.name, r.km) for r in spatial.nearest_segment(p, roads.where("ord = 1"), 15.0, ["name"]).collect()}
    assert set(got) == {1, 2} and got[1][1] == pytest.approx(km((66.5, 179.9), (66.5, -179.95)), abs=0.01)
    assert {r.id: r.name for r in spatial.nearest_segment(p, roads, 15.0, ["name"]).collect()} == {1: "over", 2: "west"}
    area = spark.createDataFrame([("A", 0, [[ring((-179.9, 66.4), (-179.5, 66.4), (-179.5, 66.6), (-179.9, 66.6))]])], RINGS)
    edges = spatial.edges_of(area)
    got = {r.id: (r.relation, r.region) for r in spatial.area_relation(p, edges, spark.createDataFrame([("A", 1.0)], "region string, area double")).collect()}
    assert got == {1: ("near", "A"), 2: ("near", "A"), 3: ("none", None)}


def test_clusters_match_across_the_antimeridian(spark):
    schema = ingest.incident_schema(points_of(spark.createDataFrame([], STORED)))
    old = spark.createDataFrame([incident(spark, bbox_min_lat=66.5, bbox_max_lat=66.5, bbox_min_lng=-179.99, bbox_max_lng=-179.98)], schema)
    points = spark.createDataFrame([(1, 66.5, 179.995, T0, "N", "nominal", 1.0, "A", "a"), (2, 66.5, 179.90, T0, "N", "nominal", 1.0, "A", "a")], POINTS)
    clustered = points.withColumn("cluster", F.col("id"))
    assert [(r.cluster, r.incident_id) for r in I.match_clusters(clustered, old, F.lit(T0)).collect()] == [(1, 1)]


# ---- feeds
HEAD = "latitude,longitude,bright_ti4,brightness,acq_date,acq_time,frp,confidence,bright_ti5"
GOOD = "52.{:02d},104.3,{},1,2026-09-24,0512,{}.5,n,{}"


def write(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_feeds_fail_singly(spark, tmp_path):
    good = [GOOD.format(i, 300 + i, i, 280) for i in range(20)]
    short = "52.5,104.3,300,1,2026-09-24,0512,1"
    paths = {
        "good": write(tmp_path, "good.csv", [HEAD, *good, short, "52.9,104.3,,1,2026-09-24,0512,x,n,,more,fields"]),
        "bad": write(tmp_path, "bad.csv", [HEAD, *good, *[short] * 20]),
        "few": write(tmp_path, "few.csv", [HEAD, short, short, GOOD.format(77, 1, 1, 2)]),
        "head": write(tmp_path, "head.csv", [HEAD]),
        "frp": write(tmp_path, "frp.csv", [HEAD.replace("frp", "power"), *good]),
        "light": write(tmp_path, "light.csv", [HEAD.replace("bright_ti4", "b").replace("brightness", "c"), *good]),
        "none": str(tmp_path / "none.csv"),
        "empty": write(tmp_path, "empty.csv", []),
    }
    found, failed = readers.feeds(spark, paths)
    assert {r.feed: r["count"] for r in found.groupBy("feed").count().collect()} == {"good": 21, "few": 1}
    assert set(failed) == {"bad", "frp", "light", "none", "empty"} and failed["bad"] == "20 of 40 rows are invalid" and "frp" in failed["frp"] and "bright_ti4|brightness" in failed["light"]
    odd = found.where("latitude = 52.9").first()
    assert (odd.brightness, odd.bright_t31, odd.frp, odd.satellite) == (0.0, None, 0.0, "VIIRS")  # blank, though another column of that kind has a number
    assert found.where("latitude = 52.03 AND feed = 'good'").first().brightness == 303.0
    for one in ("bad", "head", "none"):
        with pytest.raises(ValueError, match="all feeds failed"):
            readers.feeds(spark, {one: paths[one]})
    twice, _ = readers.feeds(spark, {"a": paths["good"], "b": paths["few"]})
    outside = twice.limit(1).withColumn("longitude", F.lit(5.0))
    shown = readers.snapshot(twice.union(outside), [F.col("feed")])
    assert shown.count() == 22


def test_tables_without_required_columns_are_refused(spark):
    for gone in ("latitude", "acq_time", "frp", "confidence"):
        names = [c for c in HEAD.split(",") if c != gone]
        with pytest.raises(ValueError, match=gone):
            readers.hotspots_raw(spark.createDataFrame([("1",) * len(names)], ", ".join(f"{c} string" for c in names)))

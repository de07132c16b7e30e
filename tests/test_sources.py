"""Readers, sinks and streams on small landed files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberlens.operators import status
from emberlens.sources import readers, sinks
from emberlens.streaming import ingest

HEAD = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,version,bright_ti5,frp,daynight"


def landed(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    return str(tmp_path / name)


def test_hotspots(spark, tmp_path):
    good = [f"52.{i:02d},104.3,330.1,0.4,0.37,2026-09-24,{500 + i},N20,n,2.0NRT,290.2,{i}.5,D" for i in range(30)]
    bad = ["95,104.3,1,1,1,2026-09-24,0512,N,n,2,1,1,D", "52,104,1,1,1,24.09.2026,0512,N,n,2,1,1,D"]
    a = landed(tmp_path, "a.csv", ["﻿" + HEAD, *good, bad[0], "52.5,104.5,,,,2026-09-24,0512,,,,,,"])
    b = landed(tmp_path, "b.csv", [HEAD, *good[:20], *bad])
    raw = readers.hotspots_raw(readers.read_csv(spark, [a, b]))
    assert {r.problem: r.n for r in status.tally(raw).collect()} == {"latitude": 2, "date": 1}
    rows = readers.hotspots(raw)
    assert rows.count() == 31 and rows.where("file LIKE '%b.csv'").count() == 0
    filled = rows.where("latitude = 52.5").first()
    assert (filled.satellite, filled.confidence, filled.version, filled.daynight, filled.frp, filled.brightness) == ("VIIRS", "nominal", "2.0", "D", 0.0, 0.0)
    with pytest.raises(ValueError, match="acq_time"):
        readers.hotspots_raw(spark.createDataFrame([("1", "2", "3")], "latitude string, longitude string, acq_date string"))


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "observations")
    rows = [(52.3, 104.3, 330.1, 290.2, 12.5, 0.4, 0.37, "2026-09-24", "0512", "N20", "n", "2.0NRT", "D"), (52.3, 104.3, 330.1, 290.2, 99.0, 0.4, 0.37, "2026-09-24", "512", "N20", "h", "2.0NRT", "D"), (91.0, 104.3, 1.0, 1.0, 1.0, 1.0, 1.0, "2026-09-24", "0512", "N", "n", "2", "D"), (52.3, 104.3, 1.0, 1.0, 1.0, 1.0, 1.0, "2026-09-24", "2512", "N", "n", "2", "D")]
    h = spark.createDataFrame(rows, "latitude double, longitude double, brightness double, bright_t31 double, frp double, scan double, track double, acq_date string, acq_time string, satellite string, confidence string, version string, daynight string")
    o = sinks.observations(h)
    assert o.count() == 2
    assert (sinks.append_observations(o, path), sinks.append_observations(o, path)) == ((1, 1), (0, 2))
    later = o.withColumn("acquisition_date", F.date_add("acquisition_date", 40))
    assert sinks.append_observations(later, path) == (1, 1)
    stored = spark.read.parquet(path)
    assert sinks.keep_recent(stored, F.lit(dt.date(2026, 11, 3))).count() == 1
    best = sinks.dedupe_grid(h.where("latitude < 90").withColumn("ord", F.monotonically_increasing_id()), [F.col("ord")]).collect()
    assert [r.frp for r in best] == [99.0]


def test_archive_rows_and_feeds(spark, tmp_path):
    rows = [("52.1", "104", "2024-13-99", "0", ""), ("95", "104", "2024-01-01", "0", "1"), ("52", "181", "2024-01-01", "0", "1"), ("", "1", "2024-01-01", "0", "1"), ("1", "1", "x", "0", "1"), ("1", "1", "2023-01-01", "2.5", "1"), ("1", "1", "2023-01-01", "2", "-4")]
    got = readers.archive_rows(spark.createDataFrame(rows, "latitude string, longitude string, acq_date string, type string, frp string")).collect()
    assert [r.malformed for r in got] == [False, True, True, True, True, True, False] and (got[0].year, got[0].frp, got[6].frp) == (2024, 0.0, 0.0)
    (tmp_path / "good.csv").write_text("latitude,longitude,bright_ti4,acq_date,acq_time,frp,confidence\n52.5,104,300,2024-01-01,0512,1,n\n")
    (tmp_path / "bad.csv").write_text("latitude,longitude\n52.5,104\n")
    found, failed = readers.feeds(spark, {n: str(tmp_path / f"{n}.csv") for n in ("good", "bad", "none")})
    assert [r.feed for r in found.collect()] == ["good"] and set(failed) == {"bad", "none"}
    with pytest.raises(ValueError):
        readers.feeds(spark, {"none": str(tmp_path / "none.csv")})
    with pytest.raises(ValueError, match="name column"):
        readers.statistics(spark.createDataFrame([("1",)], "woodiness string"), "woodiness")
    (tmp_path / "f.geojsonl").write_text('\x1e{"type":"Feature","properties":{"level":"4"},"geometry":{"type":"Point","coordinates":[1,2]}}\n{"type":"Feature","properties":{"level":"2"},"geometry":{"type":"Point","coordinates":[3,4]}}\n')
    lines = readers.feature_lines(spark, str(tmp_path / "f.geojsonl"), {"level": ("4", "5")}).collect()
    assert [(r.kind, r.coordinates) for r in lines] == [("Point", "[1,2]")]


def test_snapshots(spark, tmp_path):
    s = sinks.Snapshots(spark, str(tmp_path / "s"))
    assert s.last_good() is None
    assert s.write(spark.range(3)) and s.last_good().count() == 3
    assert not s.write(spark.range(1), lambda df: df.count() >= 2) and s.last_good().count() == 3
    assert s.write(spark.range(5)) and s.last_good().count() == 5


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', None), (2, "=x", -1.5)], "id long, note string, v double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"), [("id", False), ("note", True), ("v", False)])
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert text == '\ufeffid,note,v\r\n1,"a""b",\r\n2,\'=x,-1.5\r\n'


def test_json_readers(spark, tmp_path):
    archive = {"version": "2024", "generatedAt": "2025-01-01", "years": [2023, 2024], "regions": {"RU-IRK": {"name": "I", "areaKm2": 775000, "years": {"2023": {"vegetation": 5, "static": 1, "offshore": 0, "frpVegetation": 2.5}}}}}
    got = readers.archive_json(spark, landed(tmp_path, "a.json", [json.dumps(archive)])).collect()
    assert [(r.region, r.year, r.vegetation) for r in got] == [("RU-IRK", 2023, 5)]
    cells = landed(tmp_path, "c.json", [json.dumps({"version": 2024, "gridDeg": 0.004, "cells": [[1, 2], [3]]})])
    assert [(r.row, r.col) for r in readers.static_cells_json(spark, cells).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="another grid"):
        readers.static_cells_json(spark, landed(tmp_path, "d.json", [json.dumps({"version": 1, "gridDeg": 0.01, "cells": [[1, 2]]})])).collect()
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"type": "Feature", "properties": {"iso": "A", "name": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"iso": "B", "name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}, {"type": "Feature", "properties": {"iso": "C"}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]
    r = readers.boundaries(spark, landed(tmp_path, "r.geojson", [json.dumps({"type": "FeatureCollection", "features": features})])).orderBy("ord").collect()
    assert [(x.region, len(x.polygons)) for x in r] == [("A", 1), ("B", 2)]


def test_map_elements(spark):
    way = lambda i, kind, **tags: {"type": "way", "id": i, "tags": {"highway": kind, **tags}, "geometry": [{"lat": 52, "lon": 104}, {"lat": 52.1, "lon": 104}]}
    elements = [way(1, "tertiary", surface="gravel"), way(2, "primary"), way(3, "track"), way(4, "footway"), {"type": "node", "id": 5, "tags": {"place": "village", "name": "V"}, "lat": 1, "lon": 2}, {"type": "node", "id": 6, "tags": {"place": "island", "name": "I"}, "lat": 1, "lon": 2}]
    e = readers.map_elements(spark.createDataFrame([(json.dumps({"elements": elements}),)], "value string"))
    assert {(r.ord, r.paved, r.track) for r in readers.roads(e).collect()} == {(1, False, False), (2, True, False), (3, False, True)}
    assert [(r.id, r.name) for r in readers.places(e).collect()] == [(5, "V")]


def test_scenes(spark):
    item = {"id": "S", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-07-14T04:30:45Z", "proj:code": "EPSG:32648", "eo:cloud_cover": 5}, "assets": {"red": {"href": "x", "raster:bands": [{"scale": 0.0001, "offset": -0.1}]}}}
    r = readers.scenes(spark.createDataFrame([(json.dumps(item),), ("{}",), ("junk",)], "value string")).collect()
    assert len(r) == 1 and (r[0].epsg, r[0].w, r[0].n, r[0].assets["red"].scale) == (32648, 1.0, 4.0, 0.0001)


def test_stream_job(spark, tmp_path):
    day = dt.date(2026, 9, 24)
    rows = [(i, "N", day, f"0{i}:00:00", 52.0 + 0.001 * i, 104.0, 1.0, "nominal") for i in range(4)]
    schema = "id long, satellite string, acquisition_date date, acquisition_time string, latitude double, longitude double, frp double, confidence string"
    source = str(tmp_path / "in")
    for part in (rows[:2], rows[:4], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def points_of(o):
        return o.select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.to_timestamp(F.concat_ws(" ", "acquisition_date", "acquisition_time")).alias("acquired_at"), "satellite", "confidence", "frp", F.lit("A").alias("region_iso"), F.lit("a").alias("region"))

    state = sinks.Snapshots(spark, str(tmp_path / "state"))
    job = ingest.incident_job(str(tmp_path / "observations"), state, points_of)
    ingest.run_available(ingest.file_stream(spark, source, schema), job, str(tmp_path / "mark"))
    assert spark.read.parquet(str(tmp_path / "observations")).count() == 4
    got = state.last_good().collect()
    assert [(r.hotspot_count, r.max_hotspot_id) for r in got] == [(4, 3)]

"""Last good values and builds against brute force; turns of activity from a stream with late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlens.operators import last_good
from emberlens.streaming import ingest

T = dt.datetime(2026, 1, 1)
at = lambda h: T + dt.timedelta(hours=h)


@pytest.mark.parametrize("span", ["day", "month"])
def test_as_of(spark, span):
    rng = random.Random(2)
    areas = ["a", "b", None, "hot", "hot", "hot"]
    loads = [(rng.choice(areas), at(rng.randrange(400)), rng.random() < 0.4, rng.randrange(100)) for _ in range(300)]
    asks = [(i, rng.choice([*areas, "none"]), at(rng.randrange(-10, 420))) for i in range(300)]
    got = last_good.as_of(spark.createDataFrame(asks, "ask long, area string, at timestamp"), spark.createDataFrame(loads, "area string, at timestamp, ok boolean, value long"), ["area"], span).collect()
    want = {}
    for i, area, t in asks:
        past = [x for x in loads if x[0] == area and x[1] <= t]
        good = [(x[1], x[3]) for x in past if x[2]]
        status = "none" if not good else "live" if max((x[1], x[2]) for x in past)[1] else "last good"
        want[i] = (area, t, status, max(good)[1] if good else None, max(good)[0] if good else None)
    assert {r.ask: (r.area, r.at, r.status, r.value, r.valid_at) for r in got} == want and len(got) == 300
    assert {w[2] for w in want.values()} == {"none", "live", "last good"}
    empty = last_good.as_of(spark.createDataFrame(asks[:1], "ask long, area string, at timestamp"), spark.createDataFrame([], "area string, at timestamp, ok boolean, value long"), ["area"])
    assert [r.status for r in empty.collect()] == ["none"]


def test_intervals(spark):
    rows = [("a", at(1), True, 1), ("a", at(2), False, None), ("a", at(3), True, 2), ("a", at(3), True, 5)]
    got = last_good.intervals(spark.createDataFrame(rows, "area string, at timestamp, ok boolean, value long"), ["area"]).orderBy("at").collect()
    assert [(r.at, r.until, r.value) for r in got] == [(at(1), at(3), 1), (at(3), None, 5)]


def test_builds_settle_each_source(spark):
    rows = [(1, "x", at(1), False, "down"), (1, "x", at(2), True, None), (1, "y", at(1), True, None), (2, "x", at(1), True, None), (2, "y", at(1), True, None), (2, "y", at(2), False, "late"), (3, "x", at(1), True, None), (3, "z", at(1), True, None)]
    got = {r.build: r for r in last_good.settled(spark.createDataFrame(rows, "build long, source string, at timestamp, ok boolean, error string"), ["build"], ["x", "y"]).collect()}
    assert {k: (r.complete, r.missing, r.errors, r.at) for k, r in got.items()} == {1: (True, [], [], at(2)), 2: (False, ["y"], ["y: late"], at(2)), 3: (False, ["y"], [], at(1))}
    lines = spark.createDataFrame([("live", T), ("last good", T), ("none", None)], "s string, t timestamp").select(last_good.status_line(F.col("s"), F.col("t")).alias("x")).collect()
    assert [r.x for r in lines] == ["as of 2026-01-01 00:00", "source unavailable, last good value of 2026-01-01 00:00", "no data"]
    assert last_good.summary(spark.range(1).withColumn("d", F.lit(1)), ["d"]).columns == ["id"]


def test_activity(spark, tmp_path):
    spark.conf.set(*ingest.STATE_STORE)
    batches = [
        [(1, at(0)), (1, at(10)), (2, at(5)), (3, None)],  # 1 is quiet from then on
        [(2, at(40)), (2, at(100)), (4, at(300))],  # a quiet spell inside a batch
        [(4, at(310)), (1, at(250))],  # the others' points let 1's timer go off; then a new point
        [(2, at(90)), (4, at(500))],  # one that comes too late
        [(4, at(501))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "site long, acquired_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), "site long, acquired_at timestamp")
    out = str(tmp_path / "out")
    seen = []
    job = lambda batch, i: seen.append({(r.site, r.status) for r in batch.collect()}) or batch.write.mode("append").parquet(out)
    ingest.run_available(ingest.activity(stream, "site"), job, str(tmp_path / "mark"))
    got = sorted((r.site, r.at, r.status) for r in spark.read.parquet(out).collect())
    assert got == [
        (1, at(0), "active"), (1, at(58), "inactive"), (1, at(250), "active"), (1, at(298), "inactive"), (2, at(5), "active"), (2, at(88), "inactive"), (2, at(100), "active"), (2, at(148), "inactive"),
        (4, at(300), "active"), (4, at(358), "inactive"), (4, at(500), "active"),
    ]
    turned = next(i for i, s in enumerate(seen) if (1, "inactive") in s)
    assert turned in (2, 3)  # with no point of its own in that batch but the one that comes back, or before it

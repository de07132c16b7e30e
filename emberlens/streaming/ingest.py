"""The same work as streams: files of detections come in, observations are stored once, incidents are planned for each batch.

Event times are timestamps; late rows within the watermark count, later ones don't.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from emberlens.operators import incidents
from emberlens.shared import materialize
from emberlens.sources import sinks

WATERMARK = "72 hours"


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(stream: DataFrame, key: list[str], time: str = "acquired_at", within: str = WATERMARK) -> DataFrame:
    """Each key once within the watermark, however often its file comes again."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def daily_counts(stream: DataFrame, time: str = "acquired_at") -> DataFrame:
    """Tumbling days: count and mean of frp."""
    return stream.withWatermark(time, WATERMARK).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("frp").alias("avg_frp")).select(F.to_date("w.start").alias("day"), "n", "avg_frp")


def sessions(stream: DataFrame, keys: list[str], time: str = "acquired_at", gap: str = "48 hours") -> DataFrame:
    """Spells of activity that end after a gap."""
    return stream.withWatermark(time, WATERMARK).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("first_seen"), F.col("w.end").alias("ends"), "n")


def running_counts(stream: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """(key, n, watermark_id): per key how many rows had an id above all counted before, in state kept by Spark."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, -1)
        fresh, most = np.zeros(0, np.int64), top
        for b in batches:  # ids of the batch above the top so far, each once
            ids = b[id_column].to_numpy()
            fresh, most = np.union1d(fresh, ids[ids > top]), max(most, int(ids.max()))
        n, top = n + len(fresh), most
        state.update((n, top))
        yield pd.DataFrame({key: [k[0]], "n": [n], "watermark_id": [top]})

    return stream.select(key, id_column).groupBy(key).applyInPandasWithState(update, f"{key} long, n long, watermark_id long", "n long, top long", "update", GroupStateTimeout.NoTimeout)


class Activity(StatefulProcessor):
    """Turns of a key between active and inactive: a point makes it active, ``hours`` without a later one make it inactive. State: the last point and the status.

    A timer in event time waits for the end of the quiet spell, so a key turns inactive without new points of its own: the other keys' points move the watermark.
    A point that isn't later than the last one changes nothing."""

    def __init__(self, key: str, time: str, hours: int):
        self.key, self.time, self.quiet_ms = key, time, hours * 3_600_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("activity", "last_ms long, active boolean")

    def _rows(self, key: tuple, turns: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(turns), "status": pd.Series([s for s, _ in turns], dtype=object), "at": pd.to_datetime([ms for _, ms in turns], unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, active = self.state.get() if self.state.exists() else (None, False)
        times = np.sort(np.concatenate([b[self.time].astype("datetime64[ms]").astype("int64").to_numpy() for b in rows]))
        turns, before = [], last
        for at in times.tolist():
            if last is not None and at <= last:
                continue
            if active and at - last > self.quiet_ms:
                turns.append(("inactive", last + self.quiet_ms))
                active = False
            if not active:
                turns.append(("active", at))
            last, active = at, True
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.quiet_ms)
            self.handle.registerTimer(last + self.quiet_ms)
            self.state.update((last, active))
        yield self._rows(key, turns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, active = self.state.get()
        turns = [("inactive", last + self.quiet_ms)] if active and expiredTimerInfo.getExpiryTimeInMs() == last + self.quiet_ms else []
        self.state.update((last, active and not turns))
        yield self._rows(key, turns)

    def close(self) -> None:
        pass


#: State that has timers needs a store with a log of its own; the setting holds for queries started afterwards.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def activity(stream: DataFrame, key: str, time: str = "acquired_at", within: str = WATERMARK, hours: int = incidents.INACTIVE_AFTER_HOURS) -> DataFrame:
    """(key long, status, at): each turn of a key to active or inactive, once. Points later than the watermark allows are dropped. The turn to inactive comes out when the watermark
    has passed it, or with the point that follows the quiet spell. Null keys are one key; points without a time are left out."""
    kept = stream.where(F.col(time).isNotNull()).withWatermark(time, within).select(F.col(key).cast("long").alias(key), time)
    return kept.groupBy(key).transformWithStateInPandas(Activity(key, time, hours), f"{key} long, status string, at timestamp", "append", "EventTime")


def incident_job(observations_path: str, state: sinks.Snapshots, points_of, archive: DataFrame | None = None):
    """For foreachBatch: stores what is new, relabels incidents that turned out static, leaves points at static places out, clusters the window, plans, and writes the
    next state. A repeated batch changes nothing. Returns counts for a journal: items, written, rejected (known or repeated rows), and what the run did.

    points_of: stored observations -> points (id, lat, lon, acquired_at, satellite, confidence, frp, region_iso, region); it must not depend on other days' rows. ``archive``:
    static cells (row, col). Observations lie in folders by day: read are the mask's window, and earlier days only where an incident that a static place touches began there.
    """

    def job(batch: DataFrame, batch_id: int) -> dict:
        spark = batch.sparkSession
        written, rejected = sinks.append_observations(batch, observations_path)
        newest = sinks.newest_day(spark, observations_path)
        if newest is None:
            return {"items": written + rejected, "written": written, "rejected": rejected}
        stored = spark.read.schema(batch.schema).parquet(observations_path)
        since = lambda day: points_of(stored.where(F.col("acquisition_date") >= F.lit(day)))
        as_of = F.lit(since(newest).agg(F.max("acquired_at")).first()[0])
        recent = since(newest - dt.timedelta(days=incidents.STATIC_WINDOW_DAYS - 1))
        old = state.last_good()
        if old is None:
            old = spark.createDataFrame([], incident_schema(recent))
        touched = materialize(incidents.touched_incidents(old, recent, as_of, archive), "touched")
        began = touched.agg(F.to_date(F.min("first_seen"))).first()[0]
        members = recent if began is None else since(began)
        relabels = materialize(incidents.relabelled(touched, members, recent, as_of, archive), "relabels")
        window = materialize(incidents.in_window(recent, as_of), "window")
        run = incidents.run(window, old, relabels, materialize(incidents.static_points(window, recent, as_of, archive), "static"), as_of)
        state.write(run.state)
        return {"items": written + rejected, "written": written, "rejected": rejected} | incidents.run_counters(run.creates, run.updates, run.changes, run.relabels, run.masked).first().asDict()

    return job


def journalled(name: str, journal: sinks.Journal, work, clock=lambda: dt.datetime.now(dt.timezone.utc)):
    """For foreachBatch: ``work`` (batch, batch id) -> counts, with one row in the journal for each batch, however often it is run. A failure is journalled and raised."""

    def job(batch: DataFrame, batch_id: int) -> None:
        began = clock()
        try:
            counts = work(batch, batch_id) or {}
        except Exception as e:
            journal.record(name, batch_id, {"started_at": began, "finished_at": clock(), "outcome": "failed", "error": str(e)[:300]})
            raise
        kept = {k: v for k, v in counts.items() if k in journal.columns}
        journal.record(name, batch_id, {"started_at": began, "finished_at": clock(), "outcome": "updated"} | kept)

    return job


def refresh(name: str, run_id: int, journal: sinks.Journal, snapshots: sinks.Snapshots, load, is_valid=lambda df: df.limit(1).count() > 0, clock=lambda: dt.datetime.now(dt.timezone.utc)) -> bool:
    """One timed run of a source: ``load`` () -> rows, rejected (how many), failures (name -> reason). The rows become the next good version if they are valid; else the last
    good one stays. Failures of single parts mark the run as failed though its rows are used, as do checks that reject. Journalled once for each run_id."""
    entry = {"started_at": clock(), "outcome": "failed"}
    ok = False
    try:
        rows, rejected, failures = load()
        ok = snapshots.write(rows, is_valid)
        entry |= {"items": snapshots.last_good().count() if ok else None, "rejected": rejected, "outcome": "failed" if failures else "updated" if ok else "kept-cached"}
        if failures:
            entry["error"] = ("quality check: " + "; ".join(f"{k}: {v}" for k, v in sorted(failures.items())))[:300]
    except Exception as e:  # noqa: BLE001  a failed source never stops the others
        entry["error"] = str(e)[:300]
    journal.record(name, run_id, entry | {"finished_at": clock()})
    return ok


def retention(run_id: int, journal: sinks.Journal, spark: SparkSession, observations_path: str, as_of: dt.date, days: int = 30, clock=lambda: dt.datetime.now(dt.timezone.utc)) -> int:
    """Deletes the folders of days before the last ``days``; journals and returns how many rows went."""
    began = clock()
    gone = sinks.purge(spark, observations_path, as_of - dt.timedelta(days=days))
    journal.record("retention", run_id, {"started_at": began, "finished_at": clock(), "outcome": "updated", "items": gone})
    return gone


def incident_schema(points: DataFrame) -> StructType:
    """Columns of the incidents' state; times as the points have them."""
    time = points.schema["acquired_at"].dataType.simpleString()
    kinds = {"cluster_key": "string", "region_iso": "string", "region": "string", "status": "string", "satellite": "string", "first_seen": time, "last_seen": time}
    doubles = {"frp_max", "frp_sum", "center_lat", "center_lng", "bbox_min_lat", "bbox_min_lng", "bbox_max_lat", "bbox_max_lng"}
    return StructType.fromDDL(", ".join(f"{c} {kinds.get(c, 'double' if c in doubles else 'long')}" for c in incidents.STATE))


def run_available(stream: DataFrame, job, checkpoint: str, mode: str = "append") -> None:
    """Processes all that has arrived, batch by batch, then stops."""
    stream.writeStream.outputMode(mode).foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

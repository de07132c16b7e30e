"""Sinks: idempotent appends, retention, versioned snapshots with a last good one, CSV and GeoJSON exports."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlens.functions import numeric as N, text as T

# What makes two observations the same one, and the label of their source.
OBSERVATION_KEY = ["satellite", "acquisition_date", "acquisition_time", "latitude", "longitude"]
OBSERVATION_SOURCE = "firms_viirs_nrt"


def observations(hotspots: DataFrame) -> DataFrame:
    """Detections as stored rows: decimals, cut texts, checked times; rows that can't be stored are left out."""
    lat, lon = F.col("latitude"), F.col("longitude")
    day = F.when(F.col("acq_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp("acq_date", F.lit("yyyy-MM-dd")).cast("date"))
    money = lambda c, p, s: F.col(c).try_cast(f"decimal({p},{s})")
    out = hotspots.select(
        F.lit(OBSERVATION_SOURCE).alias("source"), F.substring("satellite", 1, 20).alias("satellite"), lat.try_cast("decimal(9,6)").alias("latitude"), lon.try_cast("decimal(10,6)").alias("longitude"),
        money("brightness", 8, 2).alias("brightness"), money("bright_t31", 8, 2).alias("brightness_t31"), money("frp", 10, 2).alias("frp"), money("scan", 5, 2).alias("scan"), money("track", 5, 2).alias("track"),
        day.alias("acquisition_date"), T.sql_time("acq_time").alias("acquisition_time"), T.normalize_confidence("confidence").alias("confidence"),
        F.substring("version", 1, 20).alias("version"), F.substring("daynight", 1, 1).alias("daynight"),
    )
    ok = N.in_range("latitude", -90, 90) & N.in_range("longitude", -180, 180) & F.col("acquisition_date").isNotNull() & F.col("acquisition_time").isNotNull() & (F.coalesce("satellite", F.lit("")) != "")
    return out.where(ok)


def dedupe_grid(hotspots: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each 0.01 degree cell: the strongest, of equals the first in ``order``. An aggregate, so a hot cell is combined before the shuffle."""
    first = F.min_by(F.struct(*hotspots.columns), F.struct((-F.col("frp")).alias("frp"), *order))
    return hotspots.groupBy(N.grid_key_100("latitude").alias("cell_y"), N.grid_key_100("longitude").alias("cell_x")).agg(first.alias("kept")).select("kept.*")


def new_observations(incoming: DataFrame, stored: DataFrame, key: list[str] = OBSERVATION_KEY) -> DataFrame:
    """Incoming rows that aren't stored yet, one for each key: of several the same in every run (the least of their other columns)."""
    others = [c for c in incoming.columns if c not in key]
    once = incoming.groupBy(*key).agg(F.min(F.struct(*others)).alias("_kept")).select(*key, "_kept.*").select(*incoming.columns) if others else incoming.select(*key).distinct()
    return once.join(stored.select(*key), key, "left_anti").select(*incoming.columns)


def append_observations(incoming: DataFrame, path: str) -> tuple[int, int]:
    """Appends what is new to the table at ``path``, in folders by day; returns how many rows were written and how many were not, as they were known or repeats. A second run writes nothing."""
    spark = incoming.sparkSession
    days = [r[0] for r in incoming.select("acquisition_date").distinct().collect()]  # calendar days
    held = spark.read.schema(incoming.schema).parquet(path).select(*incoming.columns) if exists(spark, path) else incoming.limit(0)
    stored = held.where(F.col("acquisition_date").isin(days)) if days else held.limit(0)
    observed = new_observations(incoming, stored).persist()  # counted and written from one computation
    n, total = observed.count(), incoming.count()
    if n:
        observed.write.mode("append").partitionBy("acquisition_date").parquet(path)
    observed.unpersist()
    return n, total - n


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none where there is no folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def stored_days(spark: SparkSession, path: str, column: str = "acquisition_date") -> list[dt.date]:
    """Days that a table in folders by day has, from the folders' names: no file is opened."""
    names = (n.removeprefix(f"{column}=") for n in folders(spark, path) if n.startswith(f"{column}="))
    return [dt.date.fromisoformat(n) for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n)]


def newest_day(spark: SparkSession, path: str) -> dt.date | None:
    return max(stored_days(spark, path), default=None)


def purge(spark: SparkSession, path: str, before: dt.date, column: str = "acquisition_date") -> int:
    """Deletes the folders of the days before ``before``; returns how many rows they had."""
    old = [d for d in stored_days(spark, path, column) if d < before]
    if not old:
        return 0
    n = spark.read.parquet(path).where(F.col(column) < F.lit(before)).count()
    for d in old:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={d}")
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return n


def keep_recent(rows: DataFrame, as_of: Column, days: int = 30, day: str = "acquisition_date") -> DataFrame:
    """Retention: rows of the last ``days`` days. On a table in folders by day this prunes folders."""
    return rows.where(F.col(day) >= F.date_sub(F.to_date(as_of), days))


class Journal:
    """Runs of jobs, one row for each job and run: a run has a folder of its own, which a repetition overwrites."""

    SCHEMA = (
        "started_at timestamp, finished_at timestamp, outcome string, items long, written long, rejected long, created long, updated long, deactivated long, "
        "activated long, relabelled long, masked long, error string"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = [c.split()[0] for c in self.SCHEMA.split(", ")]

    def record(self, job: str, run: int, entry: dict) -> None:
        row = tuple(entry.get(c) for c in self.columns)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/job={job}/run={run}")

    def rows(self) -> DataFrame:
        """job, run and the entry's columns."""
        schema = f"{self.SCHEMA}, job string, run long"
        if not folders(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)


class Snapshots:
    """Immutable versions of a table under one folder, each with a validity mark; readers get the newest valid one.

    A single writer is assumed. A version counts only once its mark is written, so a lost job leaves nothing half read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/marks"):
            return self.spark.createDataFrame([], "version long, valid boolean")
        return self.spark.read.schema("version long, valid boolean").json(f"{self.path}/marks")

    def last_good(self) -> DataFrame | None:
        newest = self.versions().where("valid").agg(F.max("version")).first()[0]
        return None if newest is None else self.spark.read.parquet(f"{self.path}/v={newest}")

    def write(self, df: DataFrame, is_valid: Callable[[DataFrame], bool] = lambda _: True) -> bool:
        """Writes the next version, checks what was written, and marks it. An invalid one is kept but never read."""
        version = (self.versions().agg(F.max("version")).first()[0] or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        ok = bool(is_valid(self.spark.read.parquet(f"{self.path}/v={version}")))
        self.spark.createDataFrame([(version, ok)], "version long, valid boolean").coalesce(1).write.mode("append").json(f"{self.path}/marks")
        return ok


class PublishedSets:
    """Several outputs that are published as one: all are written beside each other in a new version's folder, checked together, and one mark makes them visible.

    A run that dies between two writes, or whose check fails, leaves the set before it as it was. A single writer is assumed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _version(self) -> int | None:
        return max((int(n.removeprefix("mark=")) for n in folders(self.spark, self.path) if n.startswith("mark=")), default=None)

    def published(self) -> dict[str, DataFrame]:
        """The outputs of the newest set, by name; none before the first."""
        version = self._version()
        return {} if version is None else {n: self.spark.read.parquet(f"{self.path}/v={version}/{n}") for n in folders(self.spark, f"{self.path}/v={version}")}

    def sizes(self, version: int) -> dict[str, int]:
        """Bytes of each output as it lies there, compressed."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={version}")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {f.getPath().getName(): fs.getContentSummary(f.getPath()).getLength() for f in fs.listStatus(hadoop)}

    def publish(self, outputs: dict[str, DataFrame], problems: Callable[[dict[str, DataFrame]], list[str]] = lambda _: [], most_bytes: dict[str, int] | None = None) -> list[str]:
        """Writes a new set and makes it visible if nothing is wrong with it; returns what is. ``problems`` sees the outputs as they were written; ``most_bytes`` bounds their compressed sizes."""
        taken = [int(n.split("=")[1]) for n in folders(self.spark, self.path) if n.startswith(("v=", "mark="))]
        version = max(taken, default=0) + 1  # never one that a lost run began
        for name, df in outputs.items():
            df.write.parquet(f"{self.path}/v={version}/{name}")
        wrong = list(problems({n: self.spark.read.parquet(f"{self.path}/v={version}/{n}") for n in outputs}))
        have = self.sizes(version)
        wrong += [f"{n}: {have[n]} bytes, over {m}" for n, m in (most_bytes or {}).items() if have[n] > m]
        if not wrong:
            self.spark.range(1).coalesce(1).write.parquet(f"{self.path}/mark={version}")
        return wrong


def write_csv(df: DataFrame, path: str, columns: list[tuple[str, bool]]) -> None:
    """Lines with CRLF under a header that begins with a byte-order mark, by which spreadsheets tell the encoding; each part file is a whole table. columns: (name, whether it is text)."""
    named = ["\ufeff" * (i == 0) + c for i, (c, _) in enumerate(columns)]
    df.select(*[T.csv_cell(c, is_text).alias(n) for (c, is_text), n in zip(columns, named, strict=True)]).write.options(header=True, lineSep="\r\n", quote="", emptyValue="", nullValue="").csv(path)


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """One GeoJSON feature a line (a sequence, which any number of tasks can write)."""
    features.select(F.col(column).alias("value")).write.text(path)

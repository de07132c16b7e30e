"""Run journal, failures, freshness of sources, and quality gates: all as tables and aggregates."""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.functions import text as T
from emberlens.shared import materialize

KEPT_RUNS = 20
STATES = ("fresh", "delayed", "stale", "unknown")


# ---- journal: rows (source, at, ok, error, rejected)
def last_runs(runs: DataFrame, most: int = KEPT_RUNS) -> DataFrame:
    """The newest ``most`` runs of each source (that number is the feature), rank 1 first."""
    order = W.partitionBy("source").orderBy(F.desc("at"), F.desc("run_id"))
    return runs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def run_summary(runs: DataFrame) -> DataFrame:
    """Per source: last attempt and its outcome, last success, first failure since then, runs, failures, rejected rows (null where the journal has no such column).

    Two aggregates and a join of their few rows: no task holds a source's journal.
    """
    rejected = F.sum("rejected") if "rejected" in runs.columns else F.lit(None).cast("long")
    totals = runs.groupBy("source").agg(
        F.max("at").alias("last_attempt"), F.max_by("ok", F.struct("at", "run_id")).alias("last_ok"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"),
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("failures"), rejected.alias("rejected"),
    )
    failed = runs.where("NOT ok").join(totals.select("source", "last_success"), "source").where(F.col("last_success").isNull() | (F.col("at") > F.col("last_success")))
    return totals.join(failed.groupBy("source").agg(F.min("at").alias("failing_since")), "source", "left")


def throttled(access: DataFrame, seconds: int = 600) -> DataFrame:
    """Records that stand out from the one before: the first of a source, a change of outcome, or ``seconds`` or more after it. (Not the writer's rule: that is ``spaced``.)"""
    order = W.partitionBy("source").orderBy("at", "run_id")
    flip = F.lag("ok").over(order).isNull() | (F.lag("ok").over(order) != F.col("ok"))
    pause = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(order)) >= seconds
    return access.withColumn("write", flip | F.coalesce(pause, F.lit(False)))


def spaced(records: DataFrame, keys: list[str], seconds: int = 600, change: str | None = None) -> DataFrame:
    """Records (keys, at, run_id, ...) plus ``write``: the first of its keys, or ``seconds`` or more after the last one written; with ``change``, also
    each one in which that column differs from the record before.

    A change and a pause of that length are written in any case, so each begins a chain that nothing before it has a say in. Records are
    range-partitioned by keys and time; chains are numbered within a range, and one that goes on from the range before is joined to its beginning there. Each chain is
    walked through in time, in batches; one chain is one task's work, as each record in it depends on the last one written.
    """
    by = [F.col(k) for k in keys] + [F.col("at"), F.col("run_id")]
    cut = materialize(records.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "journal")
    order = W.partitionBy("_part", *keys).orderBy("at", "run_id")
    watched = F.col(change) if change else F.lit(0)
    ends = cut.groupBy("_part", *keys).agg(F.max_by(F.struct("at", watched.alias("seen")), F.struct("at", "run_id")).alias("_end"))  # a row for each range and key
    before = ends.select("_part", *keys, F.lag("_end").over(W.partitionBy(*keys).orderBy("_part")).alias("_before"))
    placed = cut.join(before, ["_part", *keys])
    last_at = F.coalesce(F.lag("at").over(order), F.col("_before.at"))
    pause = F.unix_millis("at") - F.unix_millis(last_at)
    begins = pause.isNull() | (pause >= seconds * 1000)
    if change:
        has = F.lag(F.lit(1)).over(order).isNotNull()
        begins = begins | ~F.when(has, F.lag(change).over(order)).otherwise(F.col("_before.seen")).eqNullSafe(F.col(change))
    chained = placed.withColumn("_begins", begins.cast("int")).withColumn("_ms", F.unix_millis("at"))
    counted = chained.withColumn("_chain", F.sum("_begins").over(order))
    sums = chained.groupBy("_part", *keys).agg(F.sum("_begins").alias("_n"))
    earlier = sums.select("_part", *keys, F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = counted.join(earlier, ["_part", *keys]).withColumn("_chain", F.col("_chain") + F.col("_base"))
    in_time = numbered.select(*records.columns, "_begins", "_chain", "_ms").repartition(*keys, "_chain").sortWithinPartitions(*keys, "_chain", "at", "run_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for rows in batches:
            write = []
            for begin, ms in zip(rows["_begins"], rows["_ms"], strict=True):
                write.append(bool(begin) or ms - last >= seconds * 1000)
                last = ms if write[-1] else last
            yield rows.drop(columns=["_begins", "_chain", "_ms"]).assign(write=write)

    return in_time.mapInPandas(walk, records.withColumn("write", F.lit(True)).schema)


# ---- freshness
def freshness(age_seconds, fresh_within, stale_after) -> Column:
    age = F.col(age_seconds) if isinstance(age_seconds, str) else age_seconds
    return F.when(age.isNull(), "unknown").when(age <= fresh_within, "fresh").when(age <= stale_after, "delayed").otherwise("stale")


def worse(*states: Column) -> Column:
    """The worst of several states; unknown counts as worst."""
    names = F.array(*[F.lit(s) for s in STATES])
    return F.element_at(names, F.greatest(*[F.array_position(names, s).cast("int") for s in states]))


def source_status(registry: DataFrame, summary: DataFrame, newest: DataFrame, as_of: Column) -> DataFrame:
    """registry (source, fresh_within, stale_after in seconds) with the journal and the newest data time -> state of data, access and both."""
    j = registry.join(summary, "source", "left").join(newest.select("source", "newest"), "source", "left")
    age = F.unix_timestamp(as_of) - F.unix_timestamp("newest")
    outage = F.unix_timestamp("last_attempt") - F.unix_timestamp("failing_since")
    data = freshness(age, F.col("fresh_within"), F.col("stale_after"))
    access = F.when(F.col("last_attempt").isNull(), "unknown").when(F.col("failing_since").isNull(), "fresh").otherwise(freshness(outage, F.col("fresh_within"), F.col("stale_after")))
    return j.select("source", age.alias("age_seconds"), data.alias("data_state"), access.alias("access_state"), worse(data, access).alias("state"), "failing_since")


# ---- gates
def problems_of(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that a row breaks, null when it breaks none. A rule is (reason, condition that must not hold)."""
    return reduce(lambda acc, r: acc.when(F.coalesce(r[1], F.lit(False)), r[0]), rules[1:], F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0]))


def tally(rows: DataFrame, reason: str = "problem") -> DataFrame:
    """(reason, n) of the rows that have one."""
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def verdict(rows: DataFrame, keys: list[str], most_share: float, least_rows: int = 20, reason: str = "problem") -> DataFrame:
    """(keys, total, rejected, passed): a file fails when it has ``least_rows`` and more than ``most_share`` of them are bad."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count(reason).alias("rejected"))
    return out.withColumn("passed", ~((F.col("total") >= least_rows) & (F.col("rejected") > F.col("total") * most_share)))


def hotspot_rules() -> list[tuple[str, Column]]:
    """Rules for rows of a detections file whose columns are all text."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return [
        ("latitude", lat.isNull() | (F.abs(lat) > 90)), ("longitude", lon.isNull() | (F.abs(lon) > 180)),
        ("date", F.col("acq_date").isNull() | ~F.col("acq_date").rlike(r"^\d{4}-\d{2}-\d{2}$")), ("time", F.coalesce(F.trim("acq_time"), F.lit("")) == ""),
    ]


# Spellings of "no value" in official tables; they are null, not errors.
PLACEHOLDER = r"(?i)^(|-|—|–|н/д|нет данных|x|х|\.{1,3})$"


def range_rule(column: str, low: float, high: float) -> tuple[str, Column]:
    """A number out of range, or text that is neither a number nor a placeholder."""
    raw, value = F.trim(F.col(column)), T.statistics_number(column)
    return f"{column} out of range", raw.isNotNull() & ~raw.rlike(PLACEHOLDER) & (value.isNull() | (value < low) | (value > high))


def loss_rules(this_year: int) -> list[tuple[str, Column]]:
    year = F.col("year")
    return [
        ("year", year.isNull() | (year != F.floor(year)) | (year < 2001) | (year > this_year)), ("area", F.col("area_ha").isNull() | (F.col("area_ha") < 0)),
        ("emissions", F.col("emissions").isNull() | (F.col("emissions") < 0)),
    ]


def count_problem(count: Column, last_good: Column, least: int = 20, share: float = 0.5) -> Column:
    """Why a list is too short to replace the last good one; null when it isn't."""
    return F.when(count < least, "too few").when(count < last_good * share, "fewer than half of the last")


def why(data_state, access_state) -> Column:
    """What a status line names: trouble with access before old data, null when both are fresh."""
    return F.when(~F.col(access_state).isin("fresh", "unknown"), F.concat(F.lit("access "), F.col(access_state))).when(F.col(data_state) != "fresh", F.concat(F.lit("data "), F.col(data_state)))


def newest_record(*tables: DataFrame, column: str = "created_at") -> DataFrame:
    """(newest): the newest time over several tables, null when all are empty."""
    tops = reduce(DataFrame.union, [t.agg(F.max(column).alias("newest")) for t in tables])  # a row for each table
    return tops.agg(F.max("newest").alias("newest"))


def provenance(registry: DataFrame, runs: DataFrame, versions: DataFrame) -> DataFrame:
    """registry (source, name, owner, license, homepage, history) x journal x versions (source, version) -> the registry's facts, last_load (newest run of the
    source that didn't fail), last_history_write (the same of its ``history`` journal) and version; null where unknown."""
    good = runs.where("ok").groupBy("source").agg(F.max("at").alias("last_load"))
    written = good.select(F.col("source").alias("history"), F.col("last_load").alias("last_history_write"))
    return registry.join(good, "source", "left").join(written, "history", "left").join(versions.select("source", "version"), "source", "left").drop("history")


# ---- verdicts of quality checks: rows (run_id, source, check, total, rejected, ok, reason)
def verdict_rows(verdicts: DataFrame, source: str, check: str, reason: str) -> DataFrame:
    """What ``verdict`` says (total, rejected, passed, ...) -> rows for the quality log; the reason stands where a check failed."""
    failed = F.when(~F.col("passed"), reason)
    return verdicts.select(F.lit(source).alias("source"), F.lit(check).alias("check"), "total", "rejected", F.col("passed").alias("ok"), failed.alias("reason"))


def folded(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Runs with the results of their checks: rejected (sum, 0 without any) and failures (array of 'check: reason', in order of the checks' names)."""
    text = F.concat(F.col("check"), F.lit(": "), F.coalesce("reason", F.lit("rejected")))
    each = checks.groupBy("run_id").agg(F.sum("rejected").alias("rejected"), F.array_sort(F.collect_list(F.when(~F.col("ok"), text))).alias("failures"))
    out = runs.drop("rejected", "failures").join(each, "run_id", "left")
    return out.withColumns({"rejected": F.coalesce("rejected", F.lit(0)), "failures": F.coalesce("failures", F.array().cast("array<string>"))})


def subjects_problem(rows: DataFrame, name: str = "name", least: int = 75, most: int = 150) -> DataFrame:
    """(problem): one row when an official table has too few or too many distinct subjects."""
    n = rows.where(F.trim(name) != "").agg(F.count_distinct(F.lower(F.trim(name))).alias("n"))
    return n.where((F.col("n") < least) | (F.col("n") > most)).select(F.format_string("%d subjects", "n").alias("problem"))


def missing_groups(columns: list[str], groups: list[tuple[str, ...]]) -> list[str]:
    """The groups of alternative columns of which a table has none, by their first name."""
    return [g[0] for g in groups if not any(c in columns for c in g)]

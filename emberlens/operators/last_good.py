"""The newest valid value of each key and source at a time, with its status; builds that count only when all their sources are there.

Attempts are rows (keys, at, ok, ...): loads that gave a value or failed. Their valid ones hold until the next valid one, so a question about a time is an as-of join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.shared import materialize


def intervals(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Valid attempts (keys, at, ok, value) -> keys, at, until (null for the newest), value: from when to when each is the last good one. Of several at one time the largest value stands."""
    good = attempts.where("ok").groupBy(*keys, "at").agg(F.max("value").alias("value"))
    return good.withColumn("until", F.lead("at").over(W.partitionBy(*keys).orderBy("at"))).select(*keys, "at", "until", "value")


def as_of(asks: DataFrame, attempts: DataFrame, keys: list[str], span: str = "day") -> DataFrame:
    """Questions (keys, at, ...) x attempts (keys, at, ok, value) -> the questions' columns, status, value, valid_at.

    status: 'live' when the newest attempt at or before the time was valid, 'last good' when later ones failed, 'none' without a valid one (value and valid_at are null then).
    Each key and source is asked for on its own. Of attempts at one time a valid one counts, of valid ones the largest value. Null keys are keys like others. Question columns
    with the names of results are not expected.

    No task sees a key's whole history: questions and attempts meet in ``span``s of time, and what was good before a span comes from a row for each key and span.
    """
    ask = asks.select(*[F.col(c).alias(f"ask_{c}") for c in asks.columns], *keys, "at")
    own = [c for c in ask.columns if c.startswith("ask_")]
    slot = F.date_trunc(span, "at").alias("slot")
    state = F.struct("at", F.col("ok").cast("int").alias("ok"), "value")
    told = attempts.groupBy(*keys, "at").agg(F.max_by(F.struct("ok", "value"), F.struct("ok", "value")).alias("x")).select(*keys, "at", "x.ok", "x.value")
    told = materialize(told.select(*keys, slot, "at", "ok", "value"), "attempts")
    per = told.groupBy(*keys, "slot").agg(F.max(state).alias("last"), F.max(F.when(F.col("ok"), state)).alias("good"))
    slots = per.select(*keys, "slot", "last", "good").unionByName(ask.select(*keys, slot).distinct(), allowMissingColumns=True).groupBy(*keys, "slot").agg(F.max("last").alias("last"), F.max("good").alias("good"))
    before = W.partitionBy(*keys).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)  # a row for each span of a key
    carried = slots.select(*keys, "slot", F.last("last", True).over(before).alias("last0"), F.last("good", True).over(before).alias("good0"))
    # attempts stand before questions of the same time
    rows = told.select(*keys, "slot", "at", F.lit(0).alias("asks"), state.alias("s"), F.when(F.col("ok"), state).alias("g")).unionByName(ask.select(*own, *keys, slot, "at", F.lit(1).alias("asks")), allowMissingColumns=True)
    inside = W.partitionBy(*keys, "slot").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, -1)
    seen = rows.select("*", F.last("s", True).over(inside).alias("s1"), F.last("g", True).over(inside).alias("g1")).where("asks = 1")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "slot")]
    met = seen.alias("a").join(carried.alias("b"), [c for c in same], "left")
    last, good = F.coalesce("s1", "last0"), F.coalesce("g1", "good0")
    status = F.when(good.isNull(), "none").when(last["ok"] == 1, "live").otherwise("last good")
    return met.select(*[F.col(f"ask_{c}").alias(c) for c in asks.columns], status.alias("status"), good["value"].alias("value"), good["at"].alias("valid_at"))


def settled(parts: DataFrame, build: list[str], expected: list[str]) -> DataFrame:
    """Parts of builds (build, source, at, ok, error) -> build, at (of the newest part), complete, missing (array of sources without a valid part, in order), errors (array of 'source: error').

    Each source is settled on its own: its newest part counts, of parts at one time a valid one. A build is complete when every expected source has a valid part."""
    newest = parts.groupBy(*build, "source").agg(F.max("at").alias("at"), F.max_by(F.struct("ok", "error"), F.struct("at", "ok")).alias("x"))
    valid = F.array_sort(F.collect_set(F.when(F.col("x.ok"), F.col("source"))))
    errors = F.array_sort(F.collect_list(F.when(~F.col("x.ok"), F.concat_ws(": ", "source", "x.error"))))
    out = newest.groupBy(*build).agg(F.max("at").alias("at"), valid.alias("valid"), errors.alias("errors"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in expected]), F.col("valid")))
    return out.select(*build, "at", (F.size(missing) == 0).alias("complete"), missing.alias("missing"), "errors")


def summary(df: DataFrame, details: list[str]) -> DataFrame:
    """A detailed build without the columns that only a single region's page shows."""
    return df.drop(*details)


def status_line(status: Column, valid_at: Column) -> Column:
    """What a page says of a value: where it comes from and of when it is."""
    return F.when(status == "live", F.concat(F.lit("as of "), F.date_format(valid_at, "yyyy-MM-dd HH:mm"))).when(status == "last good", F.concat(F.lit("source unavailable, last good value of "), F.date_format(valid_at, "yyyy-MM-dd HH:mm"))).otherwise("no data")

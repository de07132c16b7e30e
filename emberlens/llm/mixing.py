"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over the run (time 0 to 1). Its integral is the source's cumulative token demand; a document that
begins at a given token of its source is trained on when the cumulative demand reaches that token, so the inverse of the integral
gives its position, and a range sort by position gives the order of the run. All DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.llm.names import spared
from emberlens.operators.ranges import running_sums
from emberlens.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used up to so many times.
MAX_REPEATS = 3
#: Rounds in which a smaller document fills what a source's run of whole documents leaves of its target.
FILLS = 3
#: Slope of the linear weight schedule over the run, for the sources in turn: weight(t) = 1 + slope * (2t - 1), |slope| < 1. Falling, even, rising.
SLOPES = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) -> source, ordinal, source_docs, source_size, weight, target; a row for each source, null included.

    The targets share the sum of all sizes by weight; none is above ``max_repeats`` times its source's size, and what is cut off is
    shared by weight among the others until none is above. As every target is the lesser of its cap and weight times a common
    level, one pass over the sources by cap / weight finds the level: the first at which the next source isn't capped. Both passes over
    the sources run in ranges, so there may be as many sources as hosts.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"), F.sum("size").alias("source_size"))
    per = running_sums(per, [F.col("source").asc_nulls_last()], {"ordinal": F.lit(1)}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = materialize(running_sums(per, [F.col("ratio"), F.col("ordinal")], {"capped_before": F.col("cap"), "weight_before": F.col("weight")}, "mix-ratios"), "mix-levels")
    total = F.broadcast(per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight")))  # one row
    level = (F.col("all_size") - F.col("capped_before")).cast("double") / (F.col("all_weight") - F.col("weight_before"))
    free = per.crossJoin(total).withColumn("level", level).where("ratio >= level")
    water = F.broadcast(free.agg(F.min_by("level", F.struct("ratio", "ordinal")).alias("water")))  # one row
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return per.crossJoin(water).select("source", "ordinal", "source_docs", "source_size", "weight", target.alias("target"))


def _invert(share: Column, slope: Column) -> Column:
    """Time at which a source with weight 1 + slope * (2t - 1) has seen ``share`` of its tokens: solves slope t^2 + (1 - slope) t = share. Null from the run's end on."""
    b = 1 - slope
    return F.when(share < 1, F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope)))


def _fitted(spots: DataFrame, max_repeats: int) -> DataFrame:
    """(ordinal, source_size, target, size, start) -> ordinal, base_end, take_next, fills (array of struct<start, place>): how each source comes near its target.

    The source's documents, over and over, are taken while whole ones fit. Of what is left of the target, in FILLS rounds, the longest document that fits takes a
    part (one copy more of it, if it has fewer than ``max_repeats``; of equal ones the first in the sequence). Where the next document of the sequence would come nearer, it is taken
    instead. Each round is an aggregate, so a large source is combined before it is shuffled; a start names a document, as no two with words start at one word.
    """
    copies = sum((i * F.col("source_size") + F.col("start") + F.col("size") <= F.col("target")).cast("int") for i in range(max_repeats))
    spots = spots.where("target > 0 AND size > 0").withColumn("copies", copies)
    end, after = (F.col("copies") - 1) * F.col("source_size") + F.col("start") + F.col("size"), F.col("copies") * F.col("source_size") + F.col("start")
    more = F.col("copies") < max_repeats
    ends = spots.groupBy("ordinal").agg(
        F.first("target").alias("target"), F.coalesce(F.max(F.when(F.col("copies") > 0, end)), F.lit(0)).alias("base_end"), F.min(F.when(more, F.struct(after.alias("place"), "size"))).alias("next")
    )
    none = F.array().cast("array<struct<start: bigint, place: bigint>>")
    state = materialize(ends.select("ordinal", "target", "base_end", F.col("next.size").alias("next_size"), F.col("base_end").alias("filled_to"), none.alias("fills")), "mix-fits")
    for _ in range(FILLS):
        s = state.select("ordinal", "filled_to", F.transform("fills", lambda f: f["start"]).alias("used"), F.col("target").alias("aim"))
        fits = spots.where(more).join(s, "ordinal").where((F.col("filled_to") + F.col("size") <= F.col("aim")) & ~F.array_contains("used", F.col("start")))
        best = fits.groupBy("ordinal").agg(F.max(F.struct("size", (-F.col("start")).alias("late"))).alias("best"))
        grown = F.concat("fills", F.array(F.struct((-F.col("best.late")).alias("start"), F.col("filled_to").alias("place"))))
        state = state.join(best, "ordinal", "left").withColumn("fills", F.when(F.col("best").isNotNull(), grown).otherwise(F.col("fills")))
        state = materialize(state.withColumn("filled_to", F.col("filled_to") + F.coalesce("best.size", F.lit(0))).drop("best"), "mix-fits")
    take = F.coalesce(F.col("base_end") + F.col("next_size") - F.col("target") < F.col("target") - F.col("filled_to"), F.lit(False))
    return state.select("ordinal", "base_end", take.alias("take_next"), F.when(take, none).otherwise(F.col("fills")).alias("fills"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, slopes=SLOPES) -> DataFrame:
    """Documents -> the same rows and columns, and mix_size, mix_source_size, mix_target, mix_positions.

    Size: words in the text (null: 0). A source's documents stand in the order of md5(doc_id), then doc_id, size, a hash of the text: a fixed shuffle, so
    reruns agree; the source is that sequence, over and over, as far as its target goes; ``_fitted`` says how it ends. A copy's place is the number of its middle word.
    The schedule's integral says how many words of the source are asked for by a time, ``target`` by the run's end; its inverse at the place is the copy's time
    (0 to 1). mix_positions has these times. So a source is off its target by no more than half of the sequence's next document, and by less where shorter documents
    fit. In a source without words each document has one copy, at time 0.

    Running sums are split: a source's documents are cut into about sqrt(n) ranges of md5, summed by range first, so no task gets a whole
    source, however large. Null source is a source of its own, after all others. Documents without an id are shuffled by their texts. Empty texts
    have size 0 and are taken as often as their neighbours. Repeated rows are separate documents. Empty tables give empty results. Other
    columns are kept as they are; one with the name of a result gets a ``_`` behind its name.
    """
    own = {k: c for k, c in zip((f"own_{i}" for i in range(len(docs.columns))), spared(docs.columns, ["mix_size", "mix_source_size", "mix_target", "mix_positions"]), strict=True)}
    named = dict(zip(docs.columns, own, strict=True))
    kept = docs.toDF(*own)
    doc_id, text = F.col(named["doc_id"]), F.col(named["text"])
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    md = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string"))))
    sized = kept.withColumns({"source": F.col(named["source"]), "size": size, "md": md, "tie": F.xxhash64(text), "id": doc_id})
    narrow = materialize(sized.select("source", "size", "md", "tie", "id"), "mix-sizes")
    targets = materialize(source_targets(narrow.select("source", "size"), weights, max_repeats).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.sqrt("source_docs"))).cast("long")), "mix-targets")

    def ranged(df: DataFrame, of: DataFrame) -> DataFrame:
        t = of.withColumnRenamed("source", "key")
        df = df.join(t, df["source"].eqNullSafe(t["key"])).drop("key")
        return df.withColumn("range", F.floor(F.conv(F.substring("md", 1, 8), 16, 10).cast("long") * F.col("ranges") / 4294967296))

    before = W.partitionBy("ordinal").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged(narrow, targets).groupBy("ordinal", "range").agg(F.sum("size").alias("range_size"))
    starts = materialize(starts.select("ordinal", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start")), "mix-ranges")

    def started(df: DataFrame) -> DataFrame:
        inside = W.partitionBy("ordinal", "range").orderBy("md", "id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
        return df.join(starts, ["ordinal", "range"]).withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    spots = materialize(started(ranged(narrow, targets)).select("ordinal", "source_size", "target", "size", "start"), "mix-spots")
    fitted = materialize(targets.join(_fitted(spots, max_repeats), "ordinal", "left"), "mix-fitted")
    df = started(ranged(sized, fitted))
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("ordinal") % len(slopes) + 1).cast("int"))
    place = lambda i: i * F.col("source_size") + F.col("start")
    time = lambda place: _invert((2 * place + F.col("size")).cast("double") / (2 * F.col("target")), slope)
    whole = lambda i: (place(i) + F.col("size") <= F.col("target")) | (F.coalesce("take_next", F.lit(False)) & (F.col("size") > 0) & (place(i) == F.col("base_end")))
    turns = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long")), whole)
    filling = F.filter(F.coalesce("fills", F.array().cast("array<struct<start: bigint, place: bigint>>")), lambda f: (f["start"] == F.col("start")) & (F.col("size") > 0))
    times = F.concat(F.transform(turns, lambda i: time(place(i))), F.transform(filling, lambda f: time(f["place"])))
    times = F.array_sort(F.filter(times, lambda t: t.isNotNull()))
    df = df.withColumn("positions", F.when(F.col("target") > 0, times).otherwise(F.array(F.lit(0.0))))
    made = [F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("positions").alias("mix_positions")]
    return df.select(*[F.col(k).alias(c) for k, c in own.items()], *made)


def lay_out(plan: DataFrame) -> DataFrame:
    """A plan -> a row for each copy with mix_position, range-sorted by it, then by doc_id: the order of the run.

    Rows without a copy are not in it; an empty plan gives an empty run, repeated rows their own copies. Other columns are kept; one named
    mix_position gets a ``_`` behind its name.
    """
    laid = plan.toDF(*spared(plan.columns, ["mix_position"])).withColumn("mix_position", F.explode("mix_positions")).drop("mix_positions")
    return laid.repartitionByRange("mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")


def placed(plan: DataFrame) -> DataFrame:
    """A plan -> its rows and, counted from the run as it is laid out, mix_copies, mix_taken (words), mix_first and mix_last (times of the first and last copy,
    null without one) instead of mix_positions. The run is written to the shared folder; repeated rows stay separate, an empty plan gives no rows."""
    plan = plan.toDF(*spared(plan.columns, ["mix_copies", "mix_taken", "mix_first", "mix_last", "mix_row"]))
    numbered = materialize(plan.withColumn("mix_row", F.monotonically_increasing_id()), "mix-plan")
    run = materialize(lay_out(numbered.select("mix_row", "doc_id", "mix_positions")), "mix-run")
    counts = run.groupBy("mix_row").agg(F.count(F.lit(1)).alias("mix_copies"), F.min("mix_position").alias("mix_first"), F.max("mix_position").alias("mix_last"))
    out = numbered.drop("mix_positions").join(counts, "mix_row", "left").drop("mix_row")
    copies = F.coalesce("mix_copies", F.lit(0).cast("long"))
    return out.withColumn("mix_copies", copies).withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))

"""Running sums over a whole table, split into ranges of the order so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlens.shared import materialize


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], tag: str = "ranges") -> DataFrame:
    """``rows`` plus, for each name, the sum of its column over the rows before in ``order`` (0 for the first).

    Rows are range-partitioned by the order and written; each range is summed, the few sums are accumulated (a row for each
    partition), and a window runs inside each range. Rows that are equal in the order stand in any order among themselves. Columns named
    ``range_part`` or ``range_*`` of the same names are not expected in the input.
    """
    cut = materialize(rows.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()), tag)
    totals = cut.groupBy("range_part").agg(*[F.sum(c).alias(f"range_{name}") for name, c in sums.items()])
    earlier = W.orderBy("range_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select("range_part", *[F.coalesce(F.sum(f"range_{name}").over(earlier), F.lit(0)).alias(f"range_{name}") for name in sums])
    inside = W.partitionBy("range_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = cut.join(F.broadcast(starts), "range_part")  # at most as many rows as shuffle partitions
    return out.select(*rows.columns, *[(F.col(f"range_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in sums.items()])

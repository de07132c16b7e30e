"""Connected components of an edge list by min-label propagation with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from emberlens.shared import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, component): component is the smallest node id reachable, itself included.

    Nodes without an edge don't appear. Null ends are ignored; loops and repeated edges do no harm. Each round every node takes
    the least label around it, its label's own label, and the least label around any node that it is the label of. So whole regions
    join their smallest neighbours, whatever the order of ids along a chain, and rounds go on until no label changes.
    Each round's labels are written to the shared folder, never collected; those of the round before are deleted.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    changed, old = True, labels
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("near")), "near-labels")
        hooks = near.groupBy(F.col("old").alias("node")).agg(F.min("near").alias("hook"))
        step = near.join(hooks, "node", "left").select("node", "old", F.least("near", F.coalesce("hook", "near")).alias("label"))
        jump = step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        moved = Observation()
        step = jump.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")).observe(moved, F.coalesce(F.bool_or(F.col("old") != F.col("label")), F.lit(False)).alias("any"))
        step = materialize(step, "labels")
        changed = moved.get["any"]
        discard(near, old)
        labels, old = step.select("node", "label"), step
    discard(both)
    return labels.select("node", F.col("label").alias("component"))

"""Connected components of a distributed edge table, by hooking on the smallest neighbour and contracting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable by edges (columns a, b). ``nodes`` has node, or node and an earlier label.

    Each round every root takes its smallest neighbouring root, its pointer is followed once more, and the edges are
    relabelled and thinned, so they shrink geometrically. Rounds end when no edge is left. Nothing of them
    reaches the driver.
    """
    labels = nodes if "label" in nodes.columns else nodes.select("node", F.col("node").alias("label"))
    name = labels.select(F.col("node").alias("a"), F.col("label").alias("ra")), labels.select(F.col("node").alias("b"), F.col("label").alias("rb"))
    left = checkpoint(edges.select("a", "b").join(name[0], "a").join(name[1], "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    while not left.isEmpty():
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("node"), "to")
        # Every "to" is a node of the table, since edges have both their ends there.
        jump = checkpoint(hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        labels = labels.join(jump.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        at = jump.select(F.col("node").alias("a"), F.col("to").alias("ra")), jump.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        left = checkpoint(left.join(at[0], "a").join(at[1], "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return checkpoint(labels)

"""Connected components of an edge table by contraction, all of it in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _hooked(edges: DataFrame, name: str) -> DataFrame:
    """(node, parent): every node with its least neighbour or itself, jumped once.

    The hooks are stored before they are joined: both sides of the join are then plain
    shuffles, which adaptive execution can split where many nodes have one parent.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    step = both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent"))
    step = stored(step, f"{name}-steps")
    above = step.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
    return step.join(above, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns a, b); the least node names it.

    Each round hooks every node to its least neighbour, relabels the ends of the edges and
    drops those inside one label, until no edge is left.  Rounds shrink the edges, grow with
    the logarithm of the longest path, and are written to the shared folder.  Hot nodes only
    meet in a mergeable ``min`` and in joins that adaptive execution can split.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        hooks = stored(_hooked(edges, name), f"{name}-hooks")
        if labels is None:
            labels = hooks.withColumnRenamed("parent", "component")
        else:
            up = hooks.select(F.col("node").alias("component"), "parent")
            labels = labels.join(up, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        labels = stored(labels, f"{name}-labels")
        of_a = hooks.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = hooks.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        lifted = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        edges = lifted.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = stored(edges.distinct(), f"{name}-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels

"""Connected components of a distributed edge list, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Rounds of contraction: every node moves to its smallest neighbour, edges follow,
    loops and repeats go.  Nodes should be hashes, as random ids shrink a path by a
    constant factor a round.  A node's neighbours are only ever reduced to their
    minimum (partial sums before the shuffle), and the joins have unique keys on one
    side, so a hub needs no task of its own.  Null ends and loops are ignored, except
    that a node with nothing but loops is a component by itself.  Tables go to ``scratch``.
    """
    stored = (scratch or Scratch(edges.sparkSession)).stored
    edges = stored(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    lonely = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    edges = edges.where("a <> b")
    label: DataFrame | None = None
    nodes = 2 * edges.count()
    while held := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")), "parents", 2 * held)
        pa, pb = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        if label is None:
            label = parent.withColumnRenamed("parent", "label")
        else:
            label = stored(label.join(parent.select(F.col("node").alias("label"), "parent"), "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels", nodes)
        moved = edges.join(pa, "a").join(pb, "b").where("pa <> pb")
        edges = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges", held)
    if label is None:
        return lonely.select("node", F.col("label").alias("component"))
    lonely = lonely.join(label.select("node"), "node", "left_anti")
    return label.unionByName(lonely).select("node", F.col("label").alias("component"))

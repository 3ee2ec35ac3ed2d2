"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``node, component`` with the least node of each component.

    Every round points each node to its least neighbour, follows the pointers
    four steps, and contracts the graph to the nodes pointed to; edges inside a
    contracted node vanish, so the edge list shrinks until none is left. All
    state is written to the shared folder between rounds. Nodes without edges
    don't appear; an empty list gives no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    edges = materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        least = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        least = least.select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            least = materialize(least, "pointers")
            least = least.alias("x").join(least.alias("y"), F.col("x.to") == F.col("y.node"), "left").select("x.node", F.coalesce("y.to", "x.to").alias("to"))
        least = materialize(least, "pointers")
        if labels is None:
            labels = least.select("node", F.col("to").alias("component"))
        else:
            moved = labels.alias("l").join(least.alias("m"), F.col("l.component") == F.col("m.node"), "left")
            labels = materialize(moved.select("l.node", F.coalesce("m.to", "l.component").alias("component")), "labels")
        left = edges.join(least.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").join(least.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        edges = materialize(left.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

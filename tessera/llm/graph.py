"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of all nodes in edges (a, b): root is the least node that is reachable.

    Least labels go over the edges, then each label is replaced by its own label (pointer jumping), until nothing
    changes. A hub's edges are small rows that are aggregated before they are shuffled.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        met = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("less"))
        up = labels.select(F.col("node").alias("less"), F.col("root").alias("jump"))
        after = materialize(met.join(up, "less").select("node", F.least("less", "jump").alias("now"), "root"), "labels")
        moved = after.where("now <> root").limit(1).count()
        labels = after.select("node", F.col("now").alias("root"))
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")

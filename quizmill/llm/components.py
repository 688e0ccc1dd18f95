"""Connected components of an edge table by minimum labels and pointer jumping, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """edges: a, b long. Returns node, label: the smallest node reachable, for every node that has an edge.

    Each round joins labels over the edges, takes minima (combined before the shuffle), then replaces each label by its
    own label, so that chains halve. Labels live in written tables, edges are never gathered. No edges: no rows.
    """
    both = shelf.put(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = shelf.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumn("old", F.col("node")))
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        around = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        low = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        at = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = shelf.put(low.join(at, "label").select("node", F.least("label", "far").alias("label"), "old"))
        shelf.drop(labels)
        labels = new
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")

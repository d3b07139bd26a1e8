"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import join_hot, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that links lead to) for every node of edges (a, b).

    Each round takes the least label of a node's neighbours, then its label's label, so that labels travel twice as
    far a round. Nodes of many links, and labels of many nodes, are joined by broadcast. Rounds are written to the
    shared folder; only the number of changes comes to the driver.
    """
    both = staged(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"), F.count("*").alias("c")).select("node", "c", F.least("node", "b").alias("component")), "labels")
    while True:
        near = join_hot(both, labels.withColumnRenamed("node", "b"), "b", "c").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = staged(labels.join(near, "node").select("node", "c", F.col("component").alias("old"), F.least("component", "near").alias("via")), "nearer")
        ends = staged(nearer.groupBy("via").agg(F.count("*").alias("n")).join(labels.select(F.col("node").alias("via"), F.col("component").alias("end")), "via"), "ends")
        jump = join_hot(nearer, ends, "via", "n")
        new = staged(jump.select("node", "c", F.least("via", "end").alias("component"), (F.least("via", "end") != F.col("old")).alias("changed")), "labels")
        labels = new.select("node", "c", "component")
        if new.where("changed").isEmpty():
            return labels.drop("c")

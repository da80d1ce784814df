"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest id that each end of an edge ``a, b`` reaches.

    Ids are longs. Nodes without an edge are not listed. Every round takes the smallest label among
    a node's neighbours and then the label of that label, so paths halve; labels are written to the
    shared folder after each round. Minima combine before the shuffle, and joins on a node with very
    many edges are ones Spark can split. Loops, repeated edges and no edges at all are fine.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"),
        "labels",
    )
    while True:
        of_neighbour = both.join(labels, both.b == labels.node).groupBy("a").agg(
            F.min("label").alias("near")
        )
        lower = labels.join(of_neighbour, labels.node == of_neighbour.a).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        target = labels.select(F.col("node").alias("via"), F.col("label").alias("via_label"))
        jumped = lower.join(target, F.col("label") == F.col("via")).select(
            "node", "old", F.least("label", "via_label").alias("label")
        )
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")

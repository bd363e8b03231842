"""Connected components over an edge table, by hooking and pointer jumping on saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrain.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b); label is the least node of its component.

    Each round hooks every node to its least smaller neighbour, flattens the resulting trees and contracts the edges to their
    roots, which at least halves what is left of a component. All state is in tables; only emptiness comes to the driver.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = saved(e, "edges")
    labels = saved(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not e.isEmpty():
        parent = saved(e.groupBy("b").agg(F.min("a").alias("p")).withColumnRenamed("b", "c"), "parents")
        while True:  # pointer jumping: p(c) becomes p(p(c)) until no parent has a parent
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
            jumped = saved(parent.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            parent = jumped.select("c", "p")
            if jumped.where("moved").isEmpty():
                break
        labels = saved(labels.join(parent, F.col("label") == F.col("c"), "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        for side in ("a", "b"):
            e = e.join(parent, F.col(side) == F.col("c"), "left").withColumn(side, F.coalesce("p", side)).drop("c", "p")
        e = saved(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    return labels

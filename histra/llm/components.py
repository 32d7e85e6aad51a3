"""Connected components of an edge list, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns node, component (the smallest node that can be reached), one row for each node.

    Each round every node takes the smallest label among its neighbours, then the label of its label (pointer jumping),
    until no label changes. Labels are written to the checkpoint folder after each round. Self-loops are allowed.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("n"), F.col("to").alias("far"))
        after = materialise(step.join(jump, F.col("to") == F.col("n")).select("node", F.least("to", "far").alias("component"), "was"))
        labels = after.select("node", "component")
        if after.filter("component <> was").isEmpty():
            return labels

"""Connected components of a link table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): for each node of ``links`` (a, b) the smallest node it is connected with.

    Each step takes the smallest label among the neighbours, then the label of that label, so labels travel
    twice as far with each step. Nothing is gathered: a step is two joins and a map-side minimum.
    """
    edges = scratch.cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = scratch.cut(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("_l"))
        near = edges.join(seen, "b").groupBy("a").agg(F.min("_l").alias("_near"))
        low = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("_low"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_far"))
        new = low.join(jump, F.col("_low") == F.col("_n"), "left").select("node", "_was", F.least("_low", "_far").alias("label"))
        new, moved = scratch.cut_and_count(new, F.col("label") != F.col("_was"))
        labels = new.select("node", "label")
        if not moved:
            return labels

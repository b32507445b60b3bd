"""Connected components of a list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, stored


def least_reachable(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (u, v): the smallest node reachable from it.

    Each round takes the least label among neighbours, then the label of that label. Minima are combined before
    they are shuffled and hub nodes are hot keys only of plain joins, which Spark splits. Rounds grow
    with the logarithm of the longest path; every round is a table in the shared folder.
    """
    both = links.select("u", "v").where("u <> v")
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
                    .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both.v == labels.node)
            .groupBy(F.col("u").alias("near_node"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, labels.node == near.near_node).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("parent"), F.col("label").alias("jump"))
        after = stored(
            low.join(up, low.label == up.parent).select("node", F.least("label", "jump").alias("label"), "old"), "labels"
        )
        discard(labels)
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            discard(both)
            return labels

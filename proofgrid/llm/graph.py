"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: the least node of its component, for every node that has a link.

    Each round takes the least label among a node's neighbours and then the label of that label. Both are joins of
    a table with one row for each node; minima are summed up before the shuffle, so a hub is no hot task.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links", fold=True)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels", fold=True)
    before = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lowered = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        after = materialize(lowered.join(jump, "low").select("node", "root", F.least("low", "jump").alias("next")), "labels", fold=True)
        discard(before)
        before, labels = after, after.select("node", F.col("next").alias("root"))
        if after.where("next < root").isEmpty():
            discard(both)
            return labels

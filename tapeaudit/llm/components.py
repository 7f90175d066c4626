"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cut


def components(links: DataFrame) -> DataFrame:
    """node, label for every end of a link (columns a, b); label is the smallest node that it is connected with.

    Each round a node takes the smallest label among its neighbours and then that label's own label, so paths halve;
    a round is written to the shared folder. Only links are read, never pairs of a group's members.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("before"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut(lower.join(jump, "label", "left").select("node", "before", F.coalesce(F.least("label", "further"), F.col("label")).alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> before").isEmpty():
            return labels

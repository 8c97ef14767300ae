"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the least node of its component. Each round a
    node takes the least label of its neighbours, then its label's label; rounds go by the logarithm of
    the longest chain, and each is written to the shared folder."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(spark, both, "links")
    labels = stored(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "m").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("over"))
        new = stored(spark, new.join(up, "new").select("node", "label", F.least("new", "over").alias("new")), "labels")
        labels_changed = new.where("new < label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not labels_changed:
            return labels

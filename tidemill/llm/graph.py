"""Connected components of a table of links, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import stage


def components(links: DataFrame) -> DataFrame:
    """Columns node, comp for the nodes of ``links`` (a, b): ``comp`` is one node of the component.

    Each round hooks every label that has a smaller neighbour below the smallest one, follows the
    hooks to their roots by doubling, and keeps the links between different labels. Rounds and
    doublings grow with the logarithm of the longest path.
    """
    links = stage(links.filter("a != b").select("a", "b").distinct(), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn(
        "comp", F.col("node"))
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    while True:
        parent = stage(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        if not parent.limit(1).count():
            return labels
        while parent.join(parent.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count():
            up = parent.select(F.col("hi").alias("lo"), F.col("lo").alias("top"))
            parent = stage(parent.join(up, "lo", "left").select("hi", F.coalesce("top", "lo").alias("lo")), "hooks")
        labels = stage(labels.join(parent, labels["comp"] == parent["hi"], "left").select(
            "node", F.coalesce("lo", "comp").alias("comp")), "labels")
        one = parent.select(F.col("hi").alias("lo"), F.col("lo").alias("new_lo"))
        both = (edges.join(parent.withColumnRenamed("lo", "new_hi"), "hi", "left").join(one, "lo", "left")
                .select(F.coalesce("new_hi", "hi").alias("x"), F.coalesce("new_lo", "lo").alias("y")))
        edges = stage(both.filter("x != y").select(
            F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")

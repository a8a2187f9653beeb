"""Connected components by alternating large and small stars; all state lies in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, written


def connected_components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """links (x, y) of longs -> (node, component), the component being its smallest node; a row for each node of a link.

    Each round joins links with the smallest neighbour of a node, an aggregate that combines before the shuffle. Rounds
    grow with the logarithm of the longest path; they end when all links are stars. Only that comes to the driver.

    labels (node, label) may give a node of its own component for each node of a link. Then only links of different labels
    go through the rounds, and the component is its smallest label.
    """
    if labels is not None:
        ends = links.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        ends = ends.join(labels.select(F.col("node").alias("u"), F.col("label").alias("x")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("y")), "v")
        found = connected_components(ends.select("x", "y")).withColumnRenamed("node", "label")
        return labels.join(found, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    edges = written(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        old = [edges, least]
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(*old, large, least)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end u of edges has one link only and is no other's smaller end."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

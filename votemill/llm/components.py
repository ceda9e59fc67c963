"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votemill.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it reaches) of every node that has a link.

    Each step is a group-by on nodes; a node with many links is not gathered: only its minimum is taken and
    joined back, so partial aggregates do the work. Rounds grow with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = materialize(edges, "edges")
    while not is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def is_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none itself."""
    several = edges.groupBy("u").count().filter("count > 1").select("u")
    chained = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    return several.unionByName(chained).isEmpty()

"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges(a, b); root is the component's smallest node.

    Each step is a map-side combined minimum and an equi-join, so a node of very many edges is split by Spark;
    the steps are few, as paths halve. Every step's edges are written, which keeps the plan short.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars_only(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stash(_star(both, edges_to="larger"), "edges")
        edges = stash(_star(edges, edges_to="smaller"), "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _star(edges: DataFrame, edges_to: str) -> DataFrame:
    least = stash(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
    joined = edges.join(least, F.col("a") == F.col("n"))
    if edges_to == "larger":
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges to larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return nodes.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()

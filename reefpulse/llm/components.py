"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one equi-join over the edges; nothing is gathered
per component, and edges between steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reefpulse.llm.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is tied to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node that has a link.

    ``links`` has u and v, two nodes of one orderable type; loops and repeats are
    allowed, rows with a null are not links.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    while not _stars(edges):
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )

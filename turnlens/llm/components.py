"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two group minima with partial aggregation and two joins back on the node. A component of n nodes ends as
a star of n - 1 rows, so the edge table does not grow; joins on a hot centre are ordinary equi-joins that adaptive
execution can split. Every round is written to the shared folder, which cuts the lineage. Rounds end as soon as all edges
are stars, which one grouping by node tells: no node is below two others, and none below one is above another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("m").alias("a"), F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"))
    return moved.where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether the edges, each from its smaller node a to b, are stars around the smallest nodes of their components."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("below")), F.struct(F.col("b").alias("node"), F.lit(1).alias("below")))).alias("e"))
    times = ends.groupBy("e.node").agg(F.sum("e.below").alias("below"), F.count("*").alias("n"))
    return times.where("below > 1 or below = 1 and n > 1").limit(1).count() == 0


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """For each node of an edge (a, b): node and component, the smallest node that it reaches. Loops are ignored."""
    edges = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    for i in range(1, MOST_ROUNDS):
        if _stars(edges):
            break
        edges = scratch.keep(_small(_large(edges)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), f"{name}-{i}")
        if i > 1:
            scratch.drop(f"{name}-{i - 2}")
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

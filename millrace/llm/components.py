"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a salted join, so that no node's links meet in one task;
edges are written to the shared folder between rounds. Nothing is collected but a count and
a checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, salted_join, stored


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("n"))
    return salted_join(edges, least, ["u"], "v").select("u", "v", F.least("u", "n").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    star = _least(down)
    return star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v) except the roots themselves; a root is the least node of its component."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    if before[0]:
        for _ in range(rounds):
            last, edges = edges, stored(_small_star(_large_star(edges)).distinct(), "edges")
            dropped(last)
            after = state(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

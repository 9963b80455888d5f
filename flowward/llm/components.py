"""Connected components of a graph of any size, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowward.llm.scratch import Scratch


def _least(edges: DataFrame, condition: str | None = None) -> DataFrame:
    """Each ``a`` with the least of itself and its neighbours ``b``."""
    found = edges.where(condition) if condition else edges
    return found.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the least node that can be reached.

    Large and small stars in turn: neighbours are tied to the least node seen, until each component is
    one star. Node degrees don't matter: all sums are pre-aggregated, and are written before they are joined,
    so that Spark can split the partition of a node with very many neighbours.
    """
    edges = scratch.cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = scratch.cut(_least(both))
        large = both.join(nearest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.cut(large.where("a != b").distinct())
        least = scratch.cut(_least(large))
        ties = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ties = ties.union(least.select("a", F.col("m").alias("b")))
        small = scratch.cut(ties.where("a != b").distinct())
        scratch.drop(edges, large, nearest, least)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())

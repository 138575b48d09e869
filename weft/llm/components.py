"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour (large: with a larger id) of a node moves to the node's smallest neighbour.

    The neighbours of a node are never gathered: the smallest comes from an aggregate, and a join hands it out.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, component): the smallest id reachable. Nodes without an edge are absent.

    Nulls and self-loops are ignored, repeated edges count once, an empty table gives an empty one. Each round is
    written to the shared folder, so that lineage stays short.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        old, now = now, materialize(_star(_star(now, True), False), "stars")
        forget(old)
        new = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = tuple(new)
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (u, v): links of each node to the least node it knows. Hubs are split by adaptive joins, as no
    aggregate stands on the join's partitioning."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(stage: Stage, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) to (node, component): the least node reachable, for every node of an edge."""
    edges = stage.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # settled edges are stars: every node points at one least node, which points at none
        total, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if total == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        after = stage.write(_star(_star(edges, True), False), "edges")
        stage.drop(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

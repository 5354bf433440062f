"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join, so that a node with very many neighbours is
split by the engine's handling of skewed joins; steps are written to the shared folder. Edges shrink to stars, from
each node to the smallest of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm import _store


def _least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) beside the least of u and its v, as m."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); self-loops give a component of one. No edges, no rows."""
    spark = edges.sparkSession
    edges = _store.mapped_table(edges.select("a", "b").distinct(), "edges")
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before, path = None, None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large now holds v > its new neighbour; the small star ties each node's smaller neighbours to their least.
        large = _store.mapped_table(large.where("u != v").distinct(), "large-star")
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        following = _store.mapped_table(small.where("u != v").distinct(), "small-star")
        for old in (large, *([now] if path else [])):
            _store.forget(old, spark)
        now, path = following, True
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))

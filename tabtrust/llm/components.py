"""Connected components by alternating large-star and small-star steps, each a partial aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrust.llm.scratch import small, table


def _state(edges: DataFrame) -> tuple[int, object]:
    """(edges, sum of their hashes)."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def least_ids(member: DataFrame) -> DataFrame:
    """member (cid, component, least) -> (cid, component_id): the least id of the component, whose rows stay where they are as long as components are few."""
    best = table(member.groupBy("component").agg(F.min("least").alias("component_id")), "best")
    return member.join(small(best, best.count()), "component").select("cid", "component_id")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b) of ids -> (node, component), component the least id reachable; only nodes that have an edge to another.

    The number of rounds grows with the logarithm of the longest chain. Every round is written to the shared folder.
    A node of many edges is one row of the partial aggregates; while these are few they are broadcast, so that its
    edges stay where they are, and beyond that the join of its edges is dealt anew as a skewed one.
    """
    big, low = F.greatest(a, b), F.least(a, b)
    now = table(edges.where(F.col(a) != F.col(b)).select(big.alias("u"), low.alias("v")).distinct(), "edges")
    before = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        now = both.where("v > u").join(small(least, 2 * before[0]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(small(least, 2 * before[0]), "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after

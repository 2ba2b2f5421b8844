"""Connected components of a graph that is only ever held distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.tables import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    marks = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(marks)).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected with.

    ``edges`` has columns ``a`` and ``b`` of one ordered type; only nodes of an edge between
    two different nodes are returned, edges with a null are ignored. Rounds of large-star and
    small-star: each node's neighbours are pointed to the smallest of them, until every node
    points to the root of its component. A node's smallest neighbour comes from an aggregation
    with partial results per task, and its neighbours from a join, so a hub is never
    one task's group. The rounds grow with the logarithm of a component's size.
    """
    current = scratch.write(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    seen = _fingerprint(current)
    while seen[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m")
        large = large.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        following = scratch.write(small.union(root.select("hi", F.col("m").alias("lo"))).distinct())
        now = _fingerprint(following)
        scratch.drop(current)
        current = following
        if now == seen:
            break
        seen = now
    leaves = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.union(roots)

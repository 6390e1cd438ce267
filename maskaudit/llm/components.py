"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskaudit.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo")))


def _state(edges: DataFrame) -> tuple:
    """What tells two edge tables apart: their number of edges and an order-free sum of hashes."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")
    ).collect()[0]
    return row["n"], row["h"]


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Return (node, component) for every node of ``links`` (a, b: BIGINT), component being its smallest node.

    Each round hangs nodes onto the smallest node seen from their neighbours, first those above a node, then those
    below, so paths halve and the number of rounds grows with the logarithm of the longest one. A round is written to
    the shared folder and the one before is dropped; only a count and a sum of hashes come to the driver. Links of a
    node to itself are ignored but keep the node; NULL ends are not links.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = links.where(F.col("a") == F.col("b")).select("a")
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    edges = scratch.put(edges.distinct())
    state = _state(edges)
    while True:
        after = scratch.put(_small_star(_large_star(edges).distinct()).distinct())
        scratch.drop(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    single = alone.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(roots).unionByName(single).groupBy("node").agg(F.min("component").alias("component"))


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Return for each of n points the smallest point reachable over the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame], most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b), both of one orderable type; component: its smallest node.

    Each round points nodes at the smallest neighbour known; rounds grow with the logarithm of the diameter.
    ``store`` cuts lineage (a table written to storage that outlives executors). Hubs are read through joins,
    which adaptive execution splits, and aggregated before shuffling; no neighbourhood is gathered.
    Loops and null ends are left out; an empty input gives no rows.
    """
    now = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = store(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = store(small.distinct(), "stars")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.count_distinct("a").alias("d")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    # Every node but the smallest of its component has one edge left, to that.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

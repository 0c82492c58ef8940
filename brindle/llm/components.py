"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.runtime import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of these. e: u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` of every node that has an edge; the component is its least node. edges: BIGINT ``u, v``.

    Loops, repeated and reversed edges, and NULLs do no harm; nodes that only have loops get no row. Each half round
    groups by node with partial aggregation, so a node with very many edges costs its neighbours' rows and no more; edges
    stay on the executors, and only a count and a checksum of them reach the driver.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        e = cut(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

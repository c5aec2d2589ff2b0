"""Reachability over links of pages, without a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, cut=lambda df: df) -> DataFrame:
    """node, depth: what seeds (node) reach over edges (source, target) in at most `depth` steps.

    A round joins the last frontier with the edges and takes off what is known. cut
    ends the lineage of a round (a table in a shared folder); the number of rounds is bounded by depth.
    """
    known = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for step in range(1, depth + 1):
        found = edges.join(frontier, edges["source"] == frontier["node"]).select(F.col("target").alias("node")).distinct()
        frontier = cut(found.join(known, "node", "left_anti").withColumn("depth", F.lit(step)))
        known = known.unionByName(frontier)
    return known


def balanced_order(df: DataFrame, category: str, used: DataFrame, key: str) -> DataFrame:
    """df with `weight` 1 / (1 + times its category was used) and `draw`, a repeatable weighted random key: ascending order is a weighted sample."""
    n = F.coalesce("n", F.lit(0))
    u = (F.pmod(F.xxhash64(key), F.lit(1 << 30)) + 0.5) / (1 << 30)
    weighted = df.join(used.select(category, F.col("times").alias("n")), category, "left").withColumn("weight", 1 / (1 + n))
    return weighted.withColumn("draw", -F.log(u) / F.col("weight")).drop("n")

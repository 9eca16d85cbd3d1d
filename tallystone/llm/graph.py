"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round. edges: u, v with u > v. Minima are aggregated, so no node's neighbours are ever collected."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if larger:
        new = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, label: the smallest node that each node of edges (a, b) reaches. Ends when a round changes nothing."""
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        now = materialise(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components() had not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))

"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import pin


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = (
        both.filter("v > u").join(least, F.col("u") == F.col("k"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    smallest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    joined = large.join(smallest, F.col("u") == F.col("k"))
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        .union(smallest.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    Large-star and small-star steps (Kiveris et al., 2014) on edges (a, b) of any orderable type
    until nothing changes, after a logarithmic number of steps as a rule. Each step is written to
    reliable storage. Self-loops and repeated edges are allowed; nulls are dropped.
    """
    now = pin(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct())
    mark = None
    while True:
        # Edges only ever point lower; equal counts and sums of hashes mean no change.
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(
            F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if new == mark or not new["n"]:
            break
        mark, now = new, pin(_stars(now))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

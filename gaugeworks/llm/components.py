"""Connected components of a link table, wholly distributed.

Alternating large-star and small-star rounds on (a, b) pairs of longs; every round is written
to the shared folder, so a lost executor costs one round. Stars are built with partial
minima, and a hub's rows meet their minimum in a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b); root is the smallest node reachable."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs = materialize(pairs, "links")
    while True:
        # Large star: each node hands its larger neighbours the smallest of its neighbourhood.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        # Small star: a node and its smaller neighbours all point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "small-star")
        if _same(pairs, small):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).union(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        pairs = small


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of distinct pairs agree: sizes and sums of two hashes."""
    def sums(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    return sums(a) == sums(b)

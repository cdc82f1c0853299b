"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stage

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any comparable type, self-links ignored). One row per linked node: node, root, its component's least node.

    Each round is two aggregations and two joins of the links that are left; a hub's links are met by
    a minimum that is combined before the shuffle, and are spread over tasks by salts where it comes back to them. Rounds grow with the logarithm of the size.
    """
    edges = stage(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("links")).select("a", F.least("a", "m").alias("m"), "links")
        met = lambda rows: salted_join(rows, least, ["a"], "links", 2 * mark[0], F.xxhash64("b"))  # noqa: B023, E731
        large = met(both.filter("b > a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(met(edges).filter("m < a").select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("links"))
        small = met(large).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root), where root is the smallest node of the component; only nodes that have an edge.

    Each round is two aggregations that combine before the shuffle and two joins. The smallest neighbours are written first, so a join
    has two plain exchanges and Spark splits the keys of large stars. The number of rounds grows with the logarithm of the longest chain.
    Rows may repeat and stand either way round; a row with a null links nothing.
    """
    stars = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = mark = None
    while True:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("b > a").join(least.hint("merge"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        # a node that is its own smallest neighbour keeps its larger neighbours; smaller ones arrive from their own side
        large = cut(large.distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        least = cut(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(least.hint("merge"), F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        stars = cut(small.where("a != b").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (now[0], now[1]) == (size, mark):
            break
        size, mark = now
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

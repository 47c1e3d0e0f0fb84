"""Connected components of a link table, by alternating large-star and small-star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the component's smallest node.

    Each round writes its table to the shared folder.  Work in a round is in proportion to the links; a node with very
    many links only ever meets them in aggregations with map-side combine and in joins that can be split."""
    now = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), f"{name}-0")
    stamp = None
    for i in range(1, most_rounds):
        # large star: every neighbour above me links to the smallest node I know
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every neighbour below me, and I, link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n"))
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        now = scratch.keep(new, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == stamp:
            break
        stamp = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())

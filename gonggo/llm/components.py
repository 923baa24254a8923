"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gonggo.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each linked node with the smallest node it can be reached from.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds that
    grows with the logarithm of the longest chain. Every round is joins and minima on two columns,
    written to the shared folder; links never meet in the driver, and a node with very many links is
    a skewed join that adaptive execution splits.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now

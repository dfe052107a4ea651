"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.session import store

MAX_ROUNDS = 60                # the number of rounds grows with the logarithm of the longest chain


def _star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Join each node's neighbours with its smallest one."""
    return edges.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs to (node, root): each node that is not its component's smallest, with that one."""
    pair = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = store(pair)
    for _ in range(MAX_ROUNDS):
        many = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if not many and not e.join(e.select(F.col("v").alias("_v")).distinct(), F.col("u") == F.col("_v"), "left_semi").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = store(_star(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = _star(large, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = store(down.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

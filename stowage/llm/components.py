"""Connected components of a stored table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.plans.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Returns (node, component): the smallest id reachable, for every id in the links (a, b).

    Each round is two joins on one end of the links and is written to the shared folder, so a lost
    executor costs one round at most. Rounds grow with the logarithm of the longest path. Hubs are
    pre-aggregated to their least neighbour; the joins are left to the adaptive skew join.
    """
    now = stage(edges.where("a <> b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31))),
                        F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(2**31)))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = stage(_small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct())

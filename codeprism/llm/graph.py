"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(id, component) for each end of edges (a, b): component is the smallest id reachable. Loops (a = a) are kept.

    Each step links nodes to the smallest of their neighbours (Kiveris et al. 2014). Minima are merged before their
    shuffle, and are a table of their own, so that adaptive execution can split the join of a large star's narrow edges
    with its centre's minimum. Steps end when a round changes nothing; each round is a table in the shared folder, so a
    lost executor costs one round at most.
    """
    loops = edges.where("a = b").select("a")
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, name)
    mark = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        # large star: neighbours above go to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below, and u itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = materialise(small.where("u <> v").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    ends = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).union(loops.select(F.col("a").alias("id"), F.col("a").alias("component")))
    return ends.union(roots).groupBy("id").agg(F.min("component").alias("component"))

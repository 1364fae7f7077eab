"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pneumaspark.session import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of the edges (a, b) can reach.

    Large-star and small-star steps alternate until every edge leads to a root.
    Each step groups by vertex with partial minima, so a hub costs a row per task,
    and is written out, so neither lineage nor the driver grows with the graph.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    for _ in range(rounds):
        # large star: greater neighbours of u move to u's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u > v").distinct(), "large_star")
        # small star: u and its smaller neighbours move to the least of those
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = materialize(small.where("u > v").distinct(), "small_star")
        # a star forest has no vertex that is both a child and a root
        chained = new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        several = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        e = new
        if not chained and not several:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select(F.col("v"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")

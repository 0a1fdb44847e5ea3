"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.staging import stage


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) of every end of the edges (a, b: long).

    Alternating large-star and small-star steps; each is one aggregation for the
    smallest neighbour and one join, and the edge count never grows. A node with very
    many neighbours is combined on the map side; its join side is split by the
    engine's skew handling. Each step is staged, the minima too, so that both sides of a
    join are plain exchanges. Repeated edges and loops are allowed; null ends take no part;
    an edge list that is empty, or holds loops only, gives no rows.
    """
    star = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "k"), "low")
        large = both.join(low, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, "large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), "low")
        near = large.join(least, F.col("a") == F.col("k"))
        small = near.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        new = stage(small.filter("a <> b").distinct(), "cc")
        star = new
        # done when each node with a smaller neighbour has one, and is none's smaller neighbour
        ends = star.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(star.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up + top > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

"""Connected components of a graph given as a table of links, by rounds of Spark joins.

Each round alternates two steps (public as large-star and small-star): every vertex points its larger, then its
smaller neighbours at its smallest neighbour.  Links only ever move towards smaller ends, and the rounds end
when they form stars: then each vertex points at the smallest one it can reach.  Minima are pre-aggregated; where
they are joined back, a hub's links share a key, which Spark splits among tasks (adaptive skew joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._work import saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour, which has none, or only larger ones: then nothing moves any more."""
    up = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = up.unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Every linked vertex and the smallest vertex it can reach: id, component (both bigint).

    Links count in either direction; null ends, loops and repeated links change nothing; vertices without
    links do not appear.
    """
    ends = links.select(F.col(left).cast("bigint").alias("x"), F.col(right).cast("bigint").alias("y")).where("x <> y")
    now = saved(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    while not _is_forest_of_stars(now):
        now = saved(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

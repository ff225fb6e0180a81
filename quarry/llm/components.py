"""Connected components of a graph of links, by alternating large-star and small-star steps on a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_path, written


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """id, component (the smallest id reachable) of every id that has a link. edges: two long columns a, b.

    Each round replaces the edges by stars around smaller ids with joins and minima, which Spark aggregates before
    it shuffles; no neighbour list is gathered. The edges stop changing after a logarithmic number of rounds. Links
    of an id to itself and repeated links make no difference.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    state = marks(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.join(least, "a").where("m < a").select("a", F.col("m").alias("b"))).where("a > b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b"))).distinct()
        following = written(small, name)
        drop_path(edges.sparkSession, now)
        now, before, state = following, state, marks(following)
        if state == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def marks(edges: DataFrame) -> tuple:
    """Equal for equal edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())

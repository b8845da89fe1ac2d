"""Connected components by alternating large and small stars.

Edges stay in the cluster; each round is a minimum per node, which is
pre-aggregated, and a join with the edges, whose hot keys can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MOST_ROUNDS = 60


def _replace(spark: SparkSession, old: DataFrame, new: DataFrame) -> DataFrame:
    out = shared.save(spark, new, "edges")
    shared.drop(spark, old)
    return out


def _large_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = shared.save(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    out = _replace(spark, edges, both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    shared.drop(spark, least)
    return out


def _small_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them; an edge is (larger, smaller)."""
    least = shared.save(spark, edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = _replace(spark, edges, moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    shared.drop(spark, least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none: then each star is a component."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    bad = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)")
    return bad.isEmpty()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id in ``edges`` (columns a and b, long).

    Loops and repeated edges are allowed; an id that is only in loops or in no edge is not returned. The
    result is a table in the shared folder.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = shared.save(spark, ordered, "edges")
    for _ in range(MOST_ROUNDS):
        now = _small_star(spark, _large_star(spark, now))
        if _settled(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))

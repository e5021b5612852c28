"""Connected components by alternating large-star and small-star rounds.

Each round is two shuffles of the edge list; the list converges to a star
from every vertex to the smallest id of its component in a number of rounds
that grows with the logarithm of the diameter.  Rounds are cut by reliable
checkpoints.  No neighbourhood is ever gathered: the smallest neighbour comes
from a partial aggregate and is joined back to the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.cluster import cut, partitions


#: Edges a task of a small graph takes; larger graphs use all shuffle partitions.
EDGES_PER_TASK = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def join_anew(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joined on ``key`` and its hash: both sides are shuffled anew, and Spark can split a vertex with many edges."""
    return rows.withColumn("__k", F.xxhash64(key)).join(found.withColumn("__k", F.xxhash64(key)), ["__k", key], how).drop("__k")


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks)
    linked = join_anew(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return linked.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    linked = join_anew(down, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").coalesce(tasks).distinct().coalesce(tasks)


def quick_labels(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """``(id, component)`` such that equal labels mean connected; connected vertices may still differ.

    The least neighbour, then ``jumps`` times the label of the label: a few
    shuffles where only an upper bound of what is left to do is needed.
    """
    now = _both_ways(edges.filter("a <> b")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    for _ in range(jumps):
        up = now.select(F.col("id").alias("component"), F.col("component").alias("above"))
        now = join_anew(now, up, "component", "left").select("id", F.least("component", "above").alias("component"))
    return now


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs to ``(id, component)``, one row per vertex with an edge.

    ``component`` is the smallest id reachable.  Loops, repeats and either
    direction are allowed; rows with a null end are ignored; an empty list
    gives an empty result.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    tasks = max(1, min(partitions(edges.sparkSession), now.count() // EDGES_PER_TASK + 2))
    now, seen = now.coalesce(tasks), None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now, tasks), tasks))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(tops)

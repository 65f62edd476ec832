"""Connected components by alternating large-star and small-star.

Every round is two aggregations to the smallest neighbour and two joins back
on the node; neighbourhoods are never gathered, so a hub is split like any
skewed join. Each round is cut to the shared folder. It ends when a round
leaves the edges as they were: then every node hangs on its component's
smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.session import cut

MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hi").agg(F.min("lo").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("least"))
    # neighbours above a node move to its smallest neighbour
    up = edges.select(F.col("lo").alias("hi"), F.col("hi").alias("over"))
    return up.join(least, "hi").select(F.col("over").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges)
    moved = edges.join(least, "hi").where(F.col("lo") > F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge to another node. Null
    ends, loops and repeated edges don't matter."""
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, mark = cut(now.distinct()), None
    for _ in range(MAX_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        # one row; the sum of 64-bit hashes as decimals tells the edge sets apart
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())
        if new == mark:
            stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        mark = new
    raise RuntimeError("the components did not settle")

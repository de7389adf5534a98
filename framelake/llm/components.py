"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch


def large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def is_settled(links: DataFrame) -> bool:
    """Whether links (u > v) are stars: each u has one v, and no v is a u. Then v is the smallest node of its component."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(links.select("v", F.lit(0)))
    counts = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return counts.where("ups > 1 or ups = 1 and n > 1").isEmpty()


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of links (u, v) of integers.

    Self-links name nodes without neighbours and are dropped: such nodes have no
    row. Only the answer whether the links are stars reaches the driver each round.
    """
    now = scratch.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not is_settled(now):
        after = scratch.save(small_star(large_star(now)))
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Components of graphs whose links are rows, within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.scratch import Scratch


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Spark plans by the size of the file, and sorted numbers take some hundredths of the
    memory that they take in a hash table: below the threshold for broadcasts a table would pass
    through the driver, in each round.
    """
    return df.hint("merge")


def settled(scratch: Scratch, forest: DataFrame, by: list[str]) -> DataFrame:
    """Each node's root, of a forest (by, node, up, which is the node itself for roots): pointers jump until none moves.

    A jump doubles the length of a pointer, so a path of n nodes takes log2(n).
    """
    now = scratch.save(forest)
    while True:
        ups = now.select(*by, F.col("node").alias("up"), F.col("up").alias("to"))
        jumped = scratch.save(now.join(by_shuffle(ups), [*by, "up"]).select(*by, "node", F.col("to").alias("up"), (F.col("to") != F.col("up")).alias("moved")))
        scratch.drop(now)
        now = jumped
        if now.where("moved").isEmpty():
            return now.drop("moved")


def components(scratch: Scratch, links: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, root): the smallest node reachable within its group, for each node of links (by, u, v) of numbers, u <> v.

    In a round each node points to its smallest neighbour if that is smaller, the
    pointers are followed to their ends, and links are drawn between the ends. Of
    two linked nodes one is no longer an end, so the nodes of a component halve at
    least. The driver learns only whether a table is empty.
    """
    now = scratch.save(links.select(*by, "u", "v").distinct())
    found = None
    while not now.isEmpty():
        both = now.select(*by, F.col("u").alias("node"), "v").union(now.select(*by, F.col("v").alias("node"), F.col("u").alias("v")))
        forest = both.groupBy(*by, "node").agg(F.min("v").alias("_v")).select(*by, "node", F.least("node", "_v").alias("up"))
        ends = settled(scratch, forest, by)
        end = lambda c: ends.select(*by, F.col("node").alias(c), F.col("up").alias(f"_{c}"))
        after = now.join(by_shuffle(end("u")), [*by, "u"]).join(by_shuffle(end("v")), [*by, "v"]).where("_u <> _v")
        after = scratch.save(after.select(*by, F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
        scratch.drop(now)
        if found is None:
            found = ends
        else:
            moved = found.withColumnRenamed("up", "_was").join(by_shuffle(ends.select(*by, F.col("node").alias("_was"), "up")), [*by, "_was"], "left")
            moved = scratch.save(moved.select(*by, "node", F.coalesce("up", "_was").alias("up")))
            scratch.drop(found, ends)
            found = moved
        now = after
    if found is None:
        found = now.select(*by, F.col("u").alias("node"), F.col("v").alias("up"))
    return found.withColumnRenamed("up", "root")

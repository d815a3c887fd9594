"""Connected components of a link table in Spark: hooking to the smallest neighbour and pointer jumping, cut by shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.llm.common import Shelf


def components(links: DataFrame, shelf: Shelf, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node that it is connected with.

    Each round replaces the links of a node by links to its smallest neighbour, in both directions of the order (large star,
    then small star), so that the number of rounds grows with the logarithm of the longest path. A join carries many rows of one
    node on one side only, and its sides are tables of their own, so that adaptive execution splits such a node. Nulls make no link; an empty table gives an empty one.
    """
    links = shelf.put(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = None
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        above = shelf.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(above, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = shelf.put(large.distinct())
        # small star: a node and its neighbours below go to the smallest of them
        below = shelf.put(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(below, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        small = shelf.put(small.where("hi != lo").distinct())
        now = small.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for old in (links, above, large, below):
            shelf.drop(old)
        links = small
        if now == mark:
            break
        mark = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

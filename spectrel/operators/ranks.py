"""Ranks over all rows, by several columns, without a task that sorts them all.

Rows are range-partitioned by the order's columns (and at last by any number, so that rows that tie can be dealt out), numbered within a range, and the ranges'
counts give what comes before. Ties that go on from one range to the next are settled by a table of the ranges' edges, two rows a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrel.functions.columns import require_columns
from spectrel.functions.tables import written


def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left with right's other columns, where the columns `on` are equal or both null."""
    other = right.select(*[F.col(c).alias(f"{c}of_") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}of_"))
    return left.join(other, same).drop(*[f"{c}of_" for c in on])


def global_rank(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = (), ranges: int | None = None, name: str = "rank", number: str | None = None) -> DataFrame:
    """rows with their rank from 1 in the order of the columns, by the keys; rows that tie have the same rank, as SQL's rank() gives it. number: a column with
    their number too, which ties share out among themselves in any way. Nulls come first. ranges: how many (None: the session's shuffle partitions)."""
    order, keys = list(order), list(keys)
    require_columns(rows, [*order, *keys])
    by = [*keys, *order, "any_"]
    dealt = rows.withColumn("any_", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *by) if ranges else dealt.repartitionByRange(*by)
    dealt = written(dealt.drop("any_").withColumn("range_", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "range_").orderBy(*order)
    placed = dealt.withColumn("own_", F.rank().over(within)).withColumn("place_", F.row_number().over(within))
    value = F.struct(*order)
    edges = placed.groupBy(*keys, "range_").agg(F.count("*").alias("count_"), F.min(value).alias("first_"), F.max(value).alias("last_"), F.max("own_").alias("last_rank_"))
    # a row a range, and one more where keys change
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    edges = written(edges.withColumn("before_", F.coalesce(F.sum("count_").over(before), F.lit(0))), "edges")
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("first_").alias("v_"), (F.col("before_") + 1).alias("r_")), F.struct(F.col("last_").alias("v_"), (F.col("before_") + F.col("last_rank_")).alias("r_")))).alias("e"))
    ends = ends.select(*keys, "e.*").groupBy(*keys, F.col("v_").alias("first_")).agg(F.min("r_").alias("first_rank_"))
    ranged = matched(edges.select(*keys, "range_", "before_", "first_"), ends, [*keys, "first_"]).drop("first_")
    out = matched(placed, ranged, [*keys, "range_"])
    rank = F.when(F.col("own_") == 1, F.col("first_rank_")).otherwise(F.col("before_") + F.col("own_"))
    more = [(F.col("before_") + F.col("place_")).alias(number)] if number else []
    return out.select(*rows.columns, rank.cast("long").alias(name), *more)

"""Robust aggregation of windows to parts and groups, scales, and guards against inputs unlike those of development."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.functions.columns import is_finite, require_columns
from spectrel.functions.tables import stored
from spectrel.operators.vectors import quantiles


def part_medians(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("group_id", "part"), keep: Sequence[str] = ()) -> DataFrame:
    """The median of each column by part: at most a few hundred windows a part are held at once."""
    require_columns(rows, [*keys, *columns])
    return rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in keep], *[F.median(c).alias(c) for c in columns])


def group_vectors(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By group the mean of its parts' medians: each part has the same weight."""
    return part_medians(rows, columns).groupBy("group_id").agg(*[F.avg(c).alias(c) for c in columns])


def group_scores(rows: DataFrame, columns: Sequence[str], label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """The same for scores, with the label (and keep's columns) and the number of parts used; a group with two labels fails."""
    one = F.when(F.count_distinct(label) == 1, F.min(label)).otherwise(F.raise_error(F.lit("a group has more than one label")).cast("string"))
    labels = rows.groupBy("group_id").agg(one.alias(label), *[F.min(c).alias(c) for c in keep])
    scores = part_medians(rows, columns).groupBy("group_id").agg(*[F.avg(c).alias(c) for c in columns], F.count_distinct("part").alias("parts_used"))
    return labels.join(scores, "group_id")


def robust_scale(c: str) -> Column:
    """The range between the quartiles; the deviation where that is zero; never zero."""
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    iqr, sd = q[1] - q[0], F.stddev_pop(c)
    return F.when(iqr > 1e-12, iqr).when(sd > 1e-12, sd).otherwise(F.lit(1e-12))


def exact_medians(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], keep: Sequence[str] = (), cell: int = 4096) -> DataFrame:
    """(keys, keep, columns): the exact median of each column by keys, for few keys with any number of rows. A pass counts the values of each key in 1,024
    bins; the bins that hold the middle values are cut again until they hold no more than `cell` values, which are sorted."""
    keys = list(keys)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c_"), F.col(c).cast("double").alias("v_")) for i, c in enumerate(columns)])).alias("p")
    long = stored(rows.select(*keys, pairs).select(*keys, "p.*").where("v_ is not null"))
    by = [*keys, "c_"]
    size = long.groupBy(*by).agg(F.count("*").alias("m_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    state = stored(size.select(*by, "m_", "lo_", "hi_", F.posexplode(F.array(F.floor((F.col("m_") - 1) / 2), F.floor(F.col("m_") / 2))).alias("side_", "rank_")))
    by_side = [*by, "side_"]
    inside = lambda: long.join(F.broadcast(state), by).where(F.col("v_").between(F.col("lo_"), F.col("hi_")))
    while state.where((F.col("m_") > cell) & (F.col("lo_") < F.col("hi_"))).limit(1).count():
        bin_ = F.least(F.floor(F.try_divide(F.col("v_") - F.col("lo_"), (F.col("hi_") - F.col("lo_")) / 1024)), F.lit(1023))
        bins = inside().groupBy(*by_side, "rank_", F.coalesce(bin_, F.lit(0)).alias("bin_")).agg(F.count("*").alias("m_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
        below = F.coalesce(F.sum("m_").over(Window.partitionBy(*by_side).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = bins.withColumn("below_", below).where((F.col("below_") <= F.col("rank_")) & (F.col("rank_") < F.col("below_") + F.col("m_")))
        state = stored(found.select(*by_side, "m_", "lo_", "hi_", (F.col("rank_") - F.col("below_")).alias("rank_")))
    same = state.where("lo_ = hi_").select(*by_side, F.col("lo_").alias("v_"))
    rest = inside().where("lo_ < hi_").groupBy(*by_side, "rank_").agg(F.sort_array(F.collect_list("v_")).alias("s_")).select(*by_side, F.element_at("s_", (F.col("rank_") + 1).cast("int")).alias("v_"))
    middle = same.unionByName(rest).groupBy(*by).agg(F.avg("v_").alias("v_"))
    out = middle.groupBy(*keys).agg(*[F.min(F.when(F.col("c_") == i, F.col("v_"))).alias(c) for i, c in enumerate(columns)])
    return out.join(rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in keep]), keys) if keep else out


def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in which any of the columns is null, NaN or infinite."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~is_finite(F.col(c))
    return df.where(bad)


def inconsistent(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, values) of the keys that have more or fewer than one value."""
    return df.groupBy(key).agg(F.count_distinct(column).alias("values")).where("values <> 1")


def missing_parts(rows: DataFrame, parts: Sequence[str] = ("L", "H")) -> DataFrame:
    """(group_id, missing): the parts that a group lacks."""
    have = rows.groupBy("group_id").agg(F.collect_set("part").alias("have_"))
    return have.select("group_id", F.explode(F.array_except(F.array(*[F.lit(p) for p in parts]), F.col("have_"))).alias("missing"))


def assert_none(df: DataFrame, what: str) -> None:
    """An error that shows up to five rows of df, if it has any."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in rows)}")


def calibrate_domain(vectors: DataFrame, columns: Sequence[str], safety: float = 1.05) -> tuple[DataFrame, DataFrame]:
    """(centre and scale by feature, one row with threshold, development_groups and development_distance_max) from development groups. Quartiles are exact and found by
    counts; no task holds all groups."""
    low, middle, high = quantiles(vectors, columns, (0.25, 0.5, 0.75))
    spread = vectors.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    scale = [next((v for v in (float(h - lo), spread[c] or 0.0) if v > 1e-12), 1e-12) for c, lo, h in zip(columns, low, high, strict=True)]
    params = vectors.sparkSession.range(1).select(*[F.struct(F.lit(float(m)).alias("centre"), F.lit(float(v)).alias("scale")).alias(c) for c, m, v in zip(columns, middle, scale, strict=True)])
    top = domain_distance(vectors, params, columns).agg(F.max("distance").alias("development_distance_max"), F.count("*").alias("development_groups"))
    return params, top.withColumn("threshold", F.greatest(F.col("development_distance_max") * safety, F.lit(1e-12)))


def domain_distance(vectors: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(group_id, distance): the root of the mean squared robust z. params is one row."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.pow((F.col(f"v.{c}") - F.col(f"p.{c}.centre")) / F.col(f"p.{c}.scale"), F.lit(2.0))
    joined = vectors.alias("v").crossJoin(F.broadcast(params).alias("p"))
    return joined.select("v.group_id", F.sqrt(total / len(columns)).alias("distance"))


def check_domain(vectors: DataFrame, params: DataFrame, limit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(group_id, distance, threshold, in_domain)."""
    out = domain_distance(vectors, params, columns).crossJoin(F.broadcast(limit.select("threshold")))
    return out.withColumn("in_domain", F.col("distance") <= F.col("threshold"))


def calibrate_quality(rows: DataFrame, column: str = "crest_factor", safety: float = 1.05) -> DataFrame:
    """One row: development_maximum of the parts' medians, development_groups and upper_limit."""
    parts = part_medians(rows, [column])
    return parts.agg(F.max(column).alias("development_maximum"), F.count_distinct("group_id").alias("development_groups")).withColumn("upper_limit", F.col("development_maximum") * safety)


def check_quality(rows: DataFrame, limit: DataFrame, column: str = "crest_factor") -> DataFrame:
    """(group_id, parts_over, accepted): the parts whose median exceeds the limit."""
    parts = part_medians(rows, [column]).crossJoin(F.broadcast(limit.select("upper_limit")))
    over = F.array_sort(F.collect_list(F.when(F.col(column) > F.col("upper_limit"), F.col("part"))))
    return parts.groupBy("group_id").agg(over.alias("parts_over")).withColumn("accepted", F.size("parts_over") == 0)

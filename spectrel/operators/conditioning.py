"""Conditioning of records in long form: (record keys, n, x)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.functions.columns import EPS, is_finite, require_columns

RECORD = ("group_id", "part")


def _scale(method: str, eps: float) -> tuple[Column, Column]:
    """(centre, scale) as aggregates of x."""
    x = F.col("x")
    if method == "none":
        return F.lit(0.0), F.lit(1.0)
    if method == "maxabs":
        return F.lit(0.0), F.greatest(F.max(F.abs(x)), F.lit(eps))
    if method == "rms":
        return F.lit(0.0), F.greatest(F.sqrt(F.avg(x * x)), F.lit(eps))
    if method == "zscore":
        return F.avg(x), F.greatest(F.stddev_pop(x), F.lit(eps))
    raise ValueError(f"unknown normalisation: {method}")


def by_record(facts: DataFrame) -> DataFrame:
    """facts (a row a record), to be joined to samples by a hash table of the records: the samples aren't sorted, so a task's memory doesn't grow with them."""
    return facts.hint("shuffle_hash")


def normalize(samples: DataFrame, method: str = "maxabs", keys: Sequence[str] = RECORD, eps: float = 1e-12) -> DataFrame:
    """samples with x normalised by record. The records' scales are aggregated map-side and joined back, so a long record needn't be sorted
    or held by one task."""
    require_columns(samples, [*keys, "x"])
    centre, scale = _scale(method, eps)
    if method == "none":
        return samples
    stats = samples.groupBy(*keys).agg(centre.alias("centre_"), scale.alias("scale_"))
    return samples.join(by_record(stats), list(keys)).withColumn("x", (F.col("x") - F.col("centre_")) / F.col("scale_")).drop("centre_", "scale_")


def preprocess(samples: DataFrame, normalization: str = "maxabs", remove_mean: bool = True, keys: Sequence[str] = RECORD, eps: float = 1e-12) -> DataFrame:
    """samples without their record's mean, then normalised; records with a sample that isn't finite fail.

    The scale after the mean is removed follows from aggregates of the record (least, largest, mean, deviation), so one pass is enough."""
    require_columns(samples, [*keys, "x"])
    x = F.col("x")
    checked = F.when(is_finite(x), x).otherwise(F.raise_error(F.lit("a sample isn't finite")).cast("double"))
    samples = samples.withColumn("x", checked)
    if not remove_mean:
        return normalize(samples, normalization, keys, eps)
    stats = samples.groupBy(*keys).agg(F.avg("x").alias("mean_"), F.min("x").alias("lo_"), F.max("x").alias("hi_"), F.stddev_pop("x").alias("sd_"))
    spread = {"none": F.lit(1.0), "maxabs": F.greatest(F.col("hi_") - F.col("mean_"), F.col("mean_") - F.col("lo_"), F.lit(eps)), "rms": F.greatest("sd_", F.lit(eps)), "zscore": F.greatest("sd_", F.lit(eps))}
    if normalization not in spread:
        raise ValueError(f"unknown normalisation: {normalization}")
    return samples.join(by_record(stats), list(keys)).withColumn("x", (F.col("x") - F.col("mean_")) / spread[normalization]).drop("mean_", "lo_", "hi_", "sd_")


def renormalize_sets(samples: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """All windows of a part together: without their mean, over their largest size."""
    return preprocess(samples, "maxabs", True, keys, EPS)


def quantize(samples: DataFrame, bits: int, full_scale: float | None = None, keys: Sequence[str] = RECORD) -> DataFrame:
    """samples with xq: x on 2^bits levels between -scale and scale, halves to even; zero where the scale is."""
    if bits < 2:
        raise ValueError("at least 2 bits")
    steps = float(2**bits - 1)
    if full_scale is None:
        top = samples.groupBy(*keys).agg(F.max(F.abs(F.col("x"))).alias("scale_"))
        samples = samples.join(by_record(top), list(keys)) if keys else samples.crossJoin(F.broadcast(samples.agg(F.max(F.abs(F.col("x"))).alias("scale_"))))
    else:
        samples = samples.withColumn("scale_", F.lit(float(full_scale)))
    return samples.withColumn("xq", on_levels(F.col("x"), F.col("scale_"), steps)).drop("scale_")


def on_levels(x: Column, scale: Column, steps: float | Column) -> Column:
    """x on the steps + 1 levels between -scale and scale, halves to even; zero where the scale is."""
    unit = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(x, scale)))
    level = F.rint((unit + 1) / 2 * steps) / steps * 2 - 1
    return F.when(scale > 0, level * scale).otherwise(F.lit(0.0))


def clip_range(samples: DataFrame, keys: Sequence[str] = RECORD, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """The range that a display shows: two quantiles of each record."""
    return samples.groupBy(*keys).agg(F.percentile("x", F.lit(low)).alias("low"), F.percentile("x", F.lit(high)).alias("high"))


def records(samples: DataFrame, keys: Sequence[str] = RECORD, keep: Sequence[str] = ("label",)) -> DataFrame:
    """One row a record with its samples in order as an array x: for short records; framing.blocks() cuts long ones."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"])
    return samples.groupBy(*keys).agg(*[F.min(k).alias(k) for k in keep], x.alias("x"))

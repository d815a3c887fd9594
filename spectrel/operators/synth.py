"""Synthetic signals and controlled perturbations. Random numbers depend on a seed and a sample's ids, never on partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.functions.columns import EPS, gaussian, uniform
from spectrel.functions.tables import stored
from spectrel.operators.conditioning import RECORD


def time_axis(spark: SparkSession, samples: int, fs: float) -> DataFrame:
    """(n, t)."""
    if samples <= 0 or fs <= 0:
        raise ValueError("samples and rate are positive")
    return spark.range(samples).select(F.col("id").alias("n"), (F.col("id") / fs).alias("t"))


def tone(t: Column, hz: float, amplitude: float = 1.0, phase: float = 0.0) -> Column:
    return amplitude * F.sin(2 * math.pi * hz * t + phase)


def tones(t: Column, parts: Sequence[tuple[float, float, float]]) -> Column:
    """The sum of tones (hz, amplitude, phase)."""
    out = F.lit(0.0)
    for hz, amplitude, phase in parts:
        out = out + tone(t, hz, amplitude, phase)
    return out


def amplitude_modulated(t: Column, carrier: float, modulator: float, index: float, amplitude: float = 1.0) -> Column:
    if not 0 <= index <= 1:
        raise ValueError("the modulation index is from 0 to 1")
    return amplitude * (1 + index * F.sin(2 * math.pi * modulator * t)) * F.sin(2 * math.pi * carrier * t)


def chirp(t: Column, start: float, stop: float, seconds: float) -> Column:
    """A linear sweep."""
    return F.sin(2 * math.pi * (start * t + 0.5 * ((stop - start) / seconds) * t * t))


def _rms(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms_"), F.count("*").alias("count_"))


def add_noise(samples: DataFrame, snr_db: float, seed: int, keys: Sequence[str] = RECORD) -> DataFrame:
    """samples with white noise of the power that gives the signal-to-noise ratio by record."""
    g = gaussian(seed, *[F.col(k) for k in keys], F.col("n"))
    out = samples.join(_rms(samples, keys), list(keys))
    return out.withColumn("x", F.col("x") + F.col("rms_") * 10 ** (-snr_db / 20) * g).drop("rms_", "count_")


def add_tone(samples: DataFrame, fs: float, hz: float, sir_db: float, keys: Sequence[str] = RECORD, part: str = "part", parts: Sequence[str] = ("H", "L")) -> DataFrame:
    """samples with a tone whose RMS is the part's over 10^(sir/20); its phase grows by pi/7 with the part's place among the sorted parts."""
    if not 0 <= hz <= fs / 2:
        raise ValueError("the tone lies below half the rate")
    phase = F.lit(0.0)
    for i, p in enumerate(sorted(parts)):
        phase = F.when(F.col(part) == p, i * math.pi / 7).otherwise(phase)
    out = samples.withColumn("tone_", F.sin(2 * math.pi * hz * (F.col("n") / fs) + phase))
    stats = out.groupBy(*keys).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms_"), F.sqrt(F.avg(F.col("tone_") * F.col("tone_"))).alias("seen_"))
    scaled = F.when(F.col("seen_") > EPS, F.col("tone_") * (F.col("rms_") / 10 ** (sir_db / 20) / F.col("seen_"))).otherwise(0.0)
    return out.join(stats, list(keys)).withColumn("x", F.col("x") + scaled).drop("tone_", "rms_", "seen_")


def add_impulses(samples: DataFrame, fraction: float, amplitude_rms: float, seed: int, keys: Sequence[str] = RECORD) -> DataFrame:
    """samples with max(1, round(fraction * length)) impulses of both signs in each record, at the places whose hash is smallest.

    Hashes are even: a record's samples are counted in 4,096 buckets of the hash, and only the bucket in which the number is reached is sorted, to find the last place that is struck. A
    record's RMS comes from the same counts, and what is joined to the samples is a row a record."""
    from pyspark.sql import Window

    if not 0 < fraction <= 1 or amplitude_rms <= 0:
        raise ValueError("fraction is above 0 and at most 1, the amplitude positive")
    keys, ids = list(keys), [F.col(k) for k in keys]
    out = samples.withColumn("u_", uniform(seed, *ids, F.col("n"))).withColumn("b_", F.floor(F.col("u_") * 4096))
    size = out.groupBy(*keys, "b_").agg(F.count("*").alias("size_"), F.sum(F.col("x") * F.col("x")).alias("power_"))
    every = Window.partitionBy(*keys)  # 4,096 rows a record
    upto = F.sum("size_").over(every.orderBy("b_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = size.withColumns({"upto_": upto, "count_": F.sum("size_").over(every), "rms_": F.sqrt(F.sum("power_").over(every) / F.sum("size_").over(every))})
    size = size.withColumn("wanted_", F.greatest(F.lit(1), F.rint(F.col("count_") * fraction)).cast("long"))
    limit = stored(size.where((F.col("upto_") >= F.col("wanted_")) & (F.col("upto_") - F.col("size_") < F.col("wanted_"))).select(*keys, "b_", "rms_", (F.col("wanted_") - F.col("upto_") + F.col("size_")).cast("int").alias("left_")))
    within = out.join(limit, [*keys, "b_"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("u_", "n"))).alias("s_"), F.first("left_").alias("left_"), F.first("rms_").alias("rms_"))
    last = within.select(*keys, "rms_", F.element_at("s_", F.col("left_")).alias("last_"))
    sign = F.when(uniform(seed, *ids, F.col("n"), turn=1) < 0.5, -1.0).otherwise(1.0)
    struck = F.struct("u_", "n") <= F.col("last_")
    joined = samples.withColumn("u_", uniform(seed, *ids, F.col("n"))).join(last, keys)
    return joined.withColumn("x", F.when(struck, F.col("x") + sign * amplitude_rms * F.col("rms_")).otherwise(F.col("x"))).select(*samples.columns)


def cap_per_group(rows: DataFrame, most: int | None, seed: int, group: str = "group_id", row: str = "window_id") -> DataFrame:
    """At most `most` rows of each group, those with the smallest hash; all if most is None or not positive."""
    from pyspark.sql import Window

    if most is None or most <= 0:
        return rows
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")).cast("binary"))
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(group).orderBy(order, row))).where(F.col("rank_") <= most).drop("rank_")


def controls(spark: SparkSession, samples: int = 40_000, fs: float = 40e6, seed: int = 42) -> DataFrame:
    """(group_id, part, n, x): the six synthetic controls; part H is 0.98 of part L and a little noise."""
    axis = time_axis(spark, samples, fs).withColumn("span", F.lit(samples / fs))
    return controls_over(axis, (), seed)


def controls_over(axis: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """(keys, group_id, part, n, x): the controls over the time axes (keys, n, t, span) of any number of recordings."""
    t, c, keys = axis, F.col("t"), list(keys)
    kinds = {"noise": gaussian(seed, F.lit("noise"), *[F.col(k) for k in keys], F.col("n")), "tone_1mhz": tone(c, 1e6), "tone_10_5mhz": tone(c, 10.5e6), "two_tones": tones(c, [(4e6, 1.0, 0.0), (12e6, 0.7, 0.0)]), "am": amplitude_modulated(c, 8e6, 200e3, 0.6), "chirp": chirp(c, 4e6, 16e6, F.col("span"))}
    low = t.select(*keys, "n", F.explode(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v)])).alias("group_id", "x"))
    high = low.withColumn("x", 0.98 * F.col("x") + 0.02 * gaussian(seed + 1, *[F.col(k) for k in keys], F.col("group_id"), F.col("n")))
    return low.withColumn("part", F.lit("L")).unionByName(high.withColumn("part", F.lit("H"))).select(*keys, "group_id", "part", "n", "x")

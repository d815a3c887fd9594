"""Analysis windows, periodic form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The cosine coefficients of each window, and other names for them.
COSINES = {"boxcar": (1.0, 0.0, 0.0), "hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}
ALIASES = {"rectangular": "boxcar", "rect": "boxcar", "none": "boxcar", "hanning": "hann"}


def window_name(name: str) -> str:
    key = ALIASES.get(name.strip().lower(), name.strip().lower())
    if key not in COSINES:
        raise ValueError(f"unknown window: {name}")
    return key


def weight(name: str, n: Column, size: int | Column, symmetric: bool = False) -> Column:
    """The window's value at sample n of `size`."""
    if isinstance(size, int) and size <= 0:
        raise ValueError("a window has at least one sample")
    a, b, c = COSINES[window_name(name)]
    if (b, c) == (0.0, 0.0):
        return F.lit(1.0)
    angle = n * (2 * math.pi) / (size - 1 if symmetric else size)
    out = F.lit(a) - b * F.cos(angle)
    return out + c * F.cos(2 * angle) if c else out


def weights(name: str, size: int, symmetric: bool = False) -> list[float]:
    """The same on the driver."""
    a, b, c = COSINES[window_name(name)]
    if size <= 0:
        raise ValueError("a window has at least one sample")
    step = 2 * math.pi / max(1, size - 1 if symmetric else size)
    return [a - b * math.cos(step * n) + c * math.cos(2 * step * n) for n in range(size)]


def window_table(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """name, n, w."""
    parts = [spark.range(size).select(F.lit(window_name(x)).alias("name"), F.col("id").alias("n"), weight(x, F.col("id"), size).alias("w")) for x in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def window_metrics(table: DataFrame, size: int | Column, fs: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Coherent gain, and the equivalent noise bandwidth in bins and in Hz, by name (and keys, of which size may be one)."""
    out = table.groupBy(*keys, "name").agg((F.sum("w") / size).alias("coherent_gain"), (size * F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), F.lit(2.0))).alias("enbw_bins"))
    return out.withColumn("enbw_hz", F.col("enbw_bins") * (fs / size))

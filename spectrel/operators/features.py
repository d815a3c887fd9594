"""The feature table: one row a window with 11 base features, and the power of bands, absolute and relative."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.functions.columns import EPS, finite_or, ratio
from spectrel.functions.windows import window_name
from spectrel.operators import spectral

#: The base features in order.
BASE_FEATURES = ("rms", "mean_power", "energy", "peak", "crest_factor", "dominant_fft_hz", "dominant_psd_hz", "psd_max", "psd_total_power", "spectral_centroid_hz", "spectral_bandwidth_hz")


@dataclass(frozen=True)
class FeatureConfig:
    window_size: int = 1024
    hop_size: int = 512
    windows_per_part: int = 100
    band_count: int = 20
    nperseg: int = 256
    window: str = "hann"
    fs: float = 40e6
    seed: int = 42
    bands_allowed: tuple[int, ...] = field(default=(4, 10, 20))

    def validate(self) -> FeatureConfig:
        if min(self.window_size, self.hop_size, self.windows_per_part, self.nperseg) <= 0 or self.fs <= 0:
            raise ValueError("sizes are positive")
        if self.band_count not in self.bands_allowed:
            raise ValueError(f"band_count is one of {self.bands_allowed}")
        if self.nperseg > self.window_size:
            raise ValueError("nperseg is at most the window size")
        if window_name(self.window) not in ("hann", "hamming", "blackman"):
            raise ValueError("window is hann, hamming or blackman")
        return self


def band_columns(count: int, relative: bool = True) -> list[str]:
    return [f"{'rel_' * relative}band_power_{i + 1}" for i in range(count)]


def feature_columns(count: int) -> list[str]:
    return [*BASE_FEATURES, *band_columns(count)]


def time_features(windows: DataFrame, keys: Sequence[str] = spectral.WINDOW) -> DataFrame:
    x = F.col("x")
    out = windows.groupBy(*keys).agg(F.avg(x * x).alias("mean_power"), F.sum(x * x).alias("energy"), F.max(F.abs(x)).alias("peak"))
    rms = F.sqrt("mean_power")
    return out.select(*keys, rms.alias("rms"), "mean_power", "energy", "peak", ratio(F.col("peak"), rms).alias("crest_factor"))


def spectral_features(psd: DataFrame, keys: Sequence[str] = spectral.WINDOW) -> DataFrame:
    """dominant_psd_hz, psd_max, psd_total_power, spectral_centroid_hz and spectral_bandwidth_hz: all but the integral are plain sums, from one pass."""
    p, f = finite_or(F.col("psd")), F.col("freq_hz")
    w = spectral.by_frequency(keys)
    piece = (p + F.lead(p).over(w)) / 2 * (F.lead("freq_hz").over(w) - f)
    best = F.min(F.struct((-F.round(p, 12)).alias("v"), "freq_hz", p.alias("p")))
    out = psd.withColumn("piece", piece).groupBy(*keys).agg(best.alias("b"), F.sum("piece").alias("area"), F.sum(p).alias("s0"), F.sum(f * p).alias("s1"), F.sum(f * f * p).alias("s2"))
    c = ratio(F.col("s1"), F.col("s0"))
    spread = ratio(F.col("s2"), F.col("s0")) - c * c
    return out.select(*keys, F.col("b.freq_hz").alias("dominant_psd_hz"), F.col("b.p").alias("psd_max"), F.greatest(F.coalesce("area", F.lit(0.0)), F.lit(0.0)).alias("psd_total_power"), c.alias("spectral_centroid_hz"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("spectral_bandwidth_hz"))


def relative_bands(bands: DataFrame, count: int, keys: Sequence[str] = spectral.WINDOW) -> DataFrame:
    """From (keys, band, power): band_power_i and rel_band_power_i as columns."""
    total = F.greatest(F.sum("power"), F.lit(EPS))
    one = lambda i: F.sum(F.when(F.col("band") == i + 1, F.col("power")).otherwise(0.0))
    return bands.groupBy(*keys).agg(*[one(i).alias(f"band_power_{i + 1}") for i in range(count)], *[(one(i) / total).alias(f"rel_band_power_{i + 1}") for i in range(count)])


def feature_table(windows: DataFrame, fs: float, size: int, band_count: int = 4, nperseg: int = 256, window: str = "hann", keys: Sequence[str] = spectral.WINDOW, noverlap: int | None = None) -> DataFrame:
    """(keys, features) of windows in long form."""
    fft = spectral.peak(spectral.fft_magnitude(windows, fs, size, window=window, keys=keys), "magnitude", keys).select(*keys, F.col("peak_hz").alias("dominant_fft_hz"))
    psd = spectral.welch(windows, fs, size, nperseg, noverlap, window, keys)
    bands = relative_bands(spectral.band_powers(psd, spectral.equal_bands(fs, band_count), keys), band_count, keys)
    out = time_features(windows, keys).join(fft, list(keys)).join(spectral_features(psd, keys), list(keys)).join(bands, list(keys))
    return out.select(*keys, *BASE_FEATURES, *band_columns(band_count, False), *band_columns(band_count))


def fold_bands(features: DataFrame, count: int, target: int) -> DataFrame:
    """features with the relative powers of `count` bands summed to `target` bands, the columns of both kinds replaced."""
    if count % target:
        raise ValueError("the number of bands is a multiple of the target")
    width = count // target
    total = lambda i, relative: sum((F.col(band_columns(count, relative)[j]) for j in range(i * width + 1, (i + 1) * width)), F.col(band_columns(count, relative)[i * width]))
    rest = [c for c in features.columns if c not in (*band_columns(count), *band_columns(count, False))]
    kinds = [r for r in (False, True) if band_columns(count, r)[0] in features.columns]
    return features.select(*rest, *[total(i, r).alias(band_columns(target, r)[i]) for r in kinds for i in range(target)])

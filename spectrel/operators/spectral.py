"""Spectra of framed windows, relationally: windows in long form (keys, n, x) joined with a table of weighted sines of fixed size and summed
by frequency. The sums are combined map-side, so a row for each window and frequency is what is shuffled.

A window of N samples makes N * N / 2 products here; kernels.py has the same results by FFT in Arrow batches, and is what queries use.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrel.functions.columns import decibels, finite_or, ratio
from spectrel.functions.windows import weight, weights
from spectrel.operators.vectors import vector_medians

WINDOW = ("group_id", "part", "window_id")


def twiddles(spark: SparkSession, size: int, n_fft: int, window: str, bins: int) -> DataFrame:
    """(m, k, c, s): the window's weight times cosine and minus sine, for `size` samples and `bins` frequencies. size * bins rows, whatever the data."""
    t = spark.range(size).select(F.col("id").alias("m")).crossJoin(spark.range(bins).select(F.col("id").alias("k")))
    angle = F.pmod(F.col("m") * F.col("k"), F.lit(n_fft)) * (2 * math.pi / n_fft)
    w = weight(window, F.col("m"), size)
    return t.select("m", "k", (w * F.cos(angle)).alias("c"), (-w * F.sin(angle)).alias("s"))


def transform(windows: DataFrame, keys: Sequence[str], size: int, window: str, n_fft: int | None = None, remove_mean: bool = False, n: str = "n") -> DataFrame:
    """(keys, k, re, im) for the frequencies from 0 to half of n_fft. The mean of a window is taken out of its sums, so no second pass is needed."""
    n_fft = n_fft or size
    table = F.broadcast(twiddles(windows.sparkSession, size, n_fft, window, n_fft // 2 + 1))
    x = F.col("x")
    joined = windows.join(table, F.col(n) == F.col("m"))
    mean = F.avg(x) if remove_mean else F.lit(0.0)
    return joined.groupBy(*keys, "k").agg((F.sum(x * F.col("c")) - mean * F.sum("c")).alias("re"), (F.sum(x * F.col("s")) - mean * F.sum("s")).alias("im"))


def detrend_linear(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x without the least-squares line over n."""
    fit = windows.groupBy(*keys).agg(F.avg("x").alias("mx_"), F.avg("n").alias("mn_"), ratio(F.covar_pop("n", "x"), F.var_pop("n")).alias("b_"))
    return windows.join(fit, list(keys)).withColumn("x", F.col("x") - F.col("mx_") - F.col("b_") * (F.col("n") - F.col("mn_"))).drop("mx_", "mn_", "b_")


def fft_magnitude(windows: DataFrame, fs: float, size: int, n_fft: int | None = None, window: str = "boxcar", detrend: bool = False, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, k, freq_hz, magnitude): one-sided; interior frequencies doubled; over the sum of the window's weights. A window longer than n_fft is cut."""
    n_fft = n_fft or size
    if detrend:
        windows = detrend_linear(windows, keys)
    bins = n_fft // 2 + 1
    scale = max(math.fsum(weights(window, size)), 1e-12)
    used = windows.where(F.col("n") < n_fft) if n_fft < size else windows
    spectrum = transform(used, keys, size, window, n_fft)
    double = F.when((F.col("k") > 0) & (F.col("k") < bins - 1), 2.0).otherwise(1.0) if bins > 2 else F.lit(1.0)
    return spectrum.select(*keys, "k", (F.col("k") * (fs / n_fft)).alias("freq_hz"), (double * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / scale).alias("magnitude"))


def _density(fs: float, size: int, n_fft: int, window: str) -> Column:
    norm = fs * math.fsum(w * w for w in weights(window, size))
    last = n_fft // 2 if n_fft % 2 == 0 else -1
    double = F.when((F.col("k") == 0) | (F.col("k") == last), 1.0).otherwise(2.0)
    return double * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / norm


def periodogram(windows: DataFrame, fs: float, size: int, window: str = "boxcar", n_fft: int | None = None, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, k, freq_hz, psd), constant detrend, one-sided density."""
    n_fft = n_fft or size
    return transform(windows, keys, size, window, n_fft, True).select(*keys, "k", (F.col("k") * (fs / n_fft)).alias("freq_hz"), _density(fs, size, n_fft, window).alias("psd"))


def welch(windows: DataFrame, fs: float, size: int, nperseg: int = 256, noverlap: int | None = None, window: str = "hann", keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, k, freq_hz, psd): the mean of the segments' periodograms. nperseg is cut to the size, the overlap to one less than it; what is left of a segment at
    the end is dropped."""
    nperseg = min(nperseg, size)
    noverlap = min(nperseg // 2 if noverlap is None else noverlap, nperseg - 1)
    step = nperseg - noverlap
    count = (size - noverlap) // step
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n") - nperseg + 1) / F.lit(step)))
    last = F.least(F.floor(F.col("n") / F.lit(step)), F.lit(count - 1).cast("long"))
    j = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    segments = windows.select(*keys, "n", "x", F.explode(j).alias("seg")).withColumn("n", F.col("n") - F.col("seg") * step)
    each = transform(segments, [*keys, "seg"], nperseg, window, nperseg, True).select(*keys, "k", _density(fs, nperseg, nperseg, window).alias("p"))
    return each.groupBy(*keys, "k").agg(F.avg("p").alias("psd")).select(*keys, "k", (F.col("k") * (fs / nperseg)).alias("freq_hz"), "psd")


def autocorrelation(windows: DataFrame, size: int, max_lag: int, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, lag, r): the biased autocorrelation without the mean, for lags from 0. The samples of a window are arrays, so no self-join is made."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"])
    rows = windows.groupBy(*keys).agg(x.alias("a"), F.avg("x").alias("mean"))
    rows = rows.select(*keys, F.transform("a", lambda v: v - F.col("mean")).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    products = F.zip_with(F.slice("a", F.lit(1), F.lit(size) - F.col("lag")), F.slice("a", F.col("lag") + 1, F.lit(size) - F.col("lag")), lambda p, q: p * q)
    return rows.select(*keys, F.col("lag").cast("long").alias("lag"), (F.aggregate(products, F.lit(0.0), lambda a, v: a + v) / size).alias("r"))


def blackman_tukey(windows: DataFrame, fs: float, size: int, max_lag: int | None = None, window: str = "blackman", n_fft: int | None = None, compat: bool = False, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, k, freq_hz, psd) from the weighted autocorrelation, not below 0, for the non-negative frequencies but the last of an even n_fft.

    compat: as if lag 0 stood at the first place of the lags' sequence, not in its middle, which multiplies frequency w by cos(w * max_lag)."""
    lags = min(size - 1, size // 4) if max_lag is None else min(max_lag, size - 1)
    n_fft = n_fft or 1 << max(1, (2 * lags).bit_length())
    spark, length = windows.sparkSession, 2 * lags + 1
    w = weight(window, F.col("lag") + lags, length)
    bins = (n_fft + 1) // 2
    angle = F.col("lag") * F.col("k") * (2 * math.pi / n_fft)
    table = spark.range(lags + 1).select(F.col("id").alias("lag")).crossJoin(spark.range(bins).select(F.col("id").alias("k")))
    if compat:  # the window isn't symmetric about the middle lag, both sides are summed apart
        other = weight(window, F.lit(lags) - F.col("lag"), length)
        shift = F.col("k") * (2 * math.pi * lags / n_fft)
        value = F.when(F.col("lag") == 0, w * F.cos(shift)).otherwise(w * F.cos(angle + shift) + other * F.cos(-angle + shift))
    else:
        other = weight(window, F.lit(lags) - F.col("lag"), length)
        value = F.when(F.col("lag") == 0, w).otherwise((w + other) * F.cos(angle))
    table = F.broadcast(table.select("lag", "k", value.alias("v")))
    sums = autocorrelation(windows, size, lags, keys).join(table, "lag").groupBy(*keys, "k").agg(F.sum(F.col("r") * F.col("v")).alias("s"))
    return sums.select(*keys, "k", (F.col("k") * (fs / n_fft)).alias("freq_hz"), F.greatest(F.col("s") / fs, F.lit(0.0)).alias("psd"))


def by_frequency(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("freq_hz")


def psd_power(spectrum: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, power): the integral by trapezoids, 0 at least; values that aren't finite count as 0."""
    v = finite_or(F.col("psd"))
    w = by_frequency(keys)
    piece = (v + F.lead(v).over(w)) / 2 * (F.lead("freq_hz").over(w) - F.col("freq_hz"))
    return spectrum.withColumn("piece", piece).groupBy(*keys).agg(F.greatest(F.coalesce(F.sum("piece"), F.lit(0.0)), F.lit(0.0)).alias("power"))


def band_table(rates: DataFrame, count: int, rate: str = "fs") -> DataFrame:
    """rates with band (from 1), low_hz and high_hz: bands of one width from 0 to half of each row's rate."""
    i = F.col("band") - 1
    width = lambda n: n * (F.col(rate) / 2) / count
    return rates.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long"))).alias("band")).withColumns({"low_hz": width(i), "high_hz": width(i + 1)})


def equal_bands(fs: float, count: int) -> list[tuple[float, float]]:
    """Bands of equal width from 0 to half the rate."""
    if fs <= 0 or count < 1:
        raise ValueError("a positive rate and one band at least")
    width = fs / 2 / count
    return [(i * width, (i + 1) * width) for i in range(count)]


def band_powers(spectrum: DataFrame, bands: Sequence[tuple[float, float]], keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, band from 1, power): the integral of the straight line between neighbouring frequencies over each band, so that
    adjacent bands leave no gap. Negative frequencies are mirrored, and both sides' powers added. Bands are few and fixed: each piece is cut against
    all of them in one expression."""
    if any(b <= a for a, b in bands):
        raise ValueError("a band's upper edge is above its lower one")
    sides = spectrum.select(*keys, (F.col("freq_hz") < 0).alias("side_"), F.abs("freq_hz").alias("freq_hz"), finite_or(F.col("psd")).alias("v"))
    w = by_frequency([*keys, "side_"])
    seg = sides.select(*keys, F.col("freq_hz").alias("f"), "v", F.lead("freq_hz").over(w).alias("g"), F.lead("v").over(w).alias("u")).where("g IS NOT NULL")
    slope = (F.col("u") - F.col("v")) / (F.col("g") - F.col("f"))
    parts = []
    for a, b in bands:
        lo, hi = F.greatest(F.col("f"), F.lit(float(a))), F.least(F.col("g"), F.lit(float(b)))
        at = lambda f: F.col("v") + slope * (f - F.col("f"))
        parts.append(F.sum(F.when(hi > lo, (at(lo) + at(hi)) / 2 * (hi - lo)).otherwise(0.0)))
    sums = seg.groupBy(*keys).agg(F.array(*parts).alias("p"))
    return sums.select(*keys, F.posexplode("p").alias("i", "power")).select(*keys, (F.col("i") + 1).cast("long").alias("band"), F.greatest("power", F.lit(0.0)).alias("power"))


def diagnostics(spectrum: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, floor_db, peak_db, contrast_db): median and largest density in dB."""
    db = decibels(finite_or(F.col("psd")))
    out = spectrum.withColumn("db", db).groupBy(*keys).agg(F.median("db").alias("floor_db"), F.max("db").alias("peak_db"))
    return out.withColumn("contrast_db", F.greatest(F.col("peak_db") - F.col("floor_db"), F.lit(0.0)))


def median_spectrum(spectra: DataFrame, width: int, step_hz: float, keys: Sequence[str] = ("part",), column: str = "psd") -> DataFrame:
    """(keys, k, freq_hz, psd): the exact median over the windows at every frequency, for any number of windows; spectra: a row a window, its densities as an
    array of `width` numbers, `step_hz` apart."""
    middle = vector_medians(spectra, keys, column, width).select(*keys, F.posexplode(column).alias("k", "psd"))
    return middle.select(*keys, F.col("k").cast("long").alias("k"), (F.col("k") * step_hz).alias("freq_hz"), "psd")


def peak(spectrum: DataFrame, value: str, keys: Sequence[str] = WINDOW, digits: int = 12) -> DataFrame:
    """(keys, peak_hz, peak): the first largest value; values that agree in `digits` decimals are equal."""
    best = F.min(F.struct((-F.round(F.col(value), digits)).alias("v"), "freq_hz", F.col(value).alias("peak")))
    return spectrum.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.freq_hz").alias("peak_hz"), F.col("b.peak").alias("peak"))


def peak_estimate(spectrum: DataFrame, expected_hz: float, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, peak_hz, contrast_db, error_hz): the peak of a magnitude spectrum against the median of all its values."""
    top = peak(spectrum, "magnitude", keys)
    floor = spectrum.groupBy(*keys).agg(F.median("magnitude").alias("floor"))
    contrast = 20 * F.log10((F.col("peak") + 1e-12) / (F.col("floor") + 1e-12))
    return top.join(floor, list(keys)).select(*keys, "peak_hz", contrast.alias("contrast_db"), F.abs(F.col("peak_hz") - expected_hz).alias("error_hz"))


def unit_area(spectrum: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    """spectrum with shape: the density over its integral."""
    return spectrum.join(psd_power(spectrum, keys), list(keys)).withColumn("shape", ratio(F.col("psd"), F.col("power"))).drop("power")


def interior(spectrum: DataFrame, fs: float) -> DataFrame:
    """spectrum without the frequency 0 and those from half the rate on."""
    return spectrum.where((F.col("freq_hz") > 0) & (F.col("freq_hz") < fs / 2))


def search_range(spectrum: DataFrame, fs: float, low: float = 0.02, high: float = 0.92) -> DataFrame:
    """spectrum at frequencies between two shares of half the rate, both excluded."""
    return spectrum.where((F.col("freq_hz") > low * (fs / 2)) & (F.col("freq_hz") < high * (fs / 2)))


def band_around(spectrum: DataFrame, fs: float, width: float, keys: Sequence[str] = WINDOW, least: float = 1.0, most: float = 0.95, otherwise: float = 0.10) -> DataFrame:
    """(keys, peak_hz, low_hz, high_hz): a band about the largest density of the search range, kept within `least` Hz and a share of half the rate. A
    spectrum without any frequency in the range has its peak at the share `otherwise` of the rate."""
    top = peak(search_range(spectrum, fs), "psd", keys)
    at = F.coalesce("peak_hz", F.lit(otherwise * fs))
    out = spectrum.select(*keys).distinct().join(top, list(keys), "left").select(*keys, at.alias("peak_hz"))
    return out.select(*keys, "peak_hz", F.greatest(F.lit(least), F.col("peak_hz") - width / 2).alias("low_hz"), F.least(F.lit(most * fs / 2), F.col("peak_hz") + width / 2).alias("high_hz"))


def most_different_band(powers: DataFrame, kind: str, one: str, other: str, keys: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """(keys, band, difference): the first band whose share of all bands' power differs most between two kinds (values of the column `kind`).
    powers: keys, kind, band, power."""
    keys = list(keys)
    total = powers.groupBy(*keys, kind).agg(F.sum("power").alias("total_"))
    share = powers.join(total, [*keys, kind]).withColumn("share_", ratio(F.col("power"), F.col("total_")))
    side = lambda v: F.sum(F.when(F.col(kind) == v, F.col("share_")))
    bands = share.groupBy(*keys, "band").agg((side(one) - side(other)).alias("d_"))
    best = F.min(F.struct((-F.round(F.abs("d_"), digits)).alias("v"), "band", F.col("d_").alias("difference"))).alias("b")
    return bands.groupBy(*keys).agg(best).select(*keys, "b.band", "b.difference")


def closed_band_power(spectrum: DataFrame, low: float, high: float, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, power): trapezoids over the frequencies from low to high, edges as they are."""
    return psd_power(spectrum.where(F.col("freq_hz").between(low, high)), keys)


def nearest_bin(spectrum: DataFrame, hz: float, keys: Sequence[str] = WINDOW) -> DataFrame:
    """(keys, freq_hz, gain_db) of the frequency nearest to hz, the lower of two."""
    best = F.min(F.struct(F.abs(F.col("freq_hz") - hz).alias("off"), "freq_hz", F.col("psd").alias("v")))
    return spectrum.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.freq_hz").alias("freq_hz"), decibels(F.col("b.v")).alias("gain_db"))


def alias_frequency(hz: Column, fs: Column | float) -> Column:
    """Where a frequency appears when sampled at fs."""
    fs = F.lit(fs) if not isinstance(fs, Column) else fs
    return F.abs(F.pmod(hz + fs / 2, fs) - fs / 2)

"""Whole records in blocks: transforms, autocorrelations and long filters against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.operators import filters as fi
from spectrel.operators import kernels
from spectrel.operators import longfft as lf


def table(spark, records):
    rows = [(g, "L", i, float(v)) for g, x in records.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "group_id string, part string, n long, x double").repartition(5)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 97, 1000, 1 << 20, 131_071, 131_073, 2 * 131_101, 1 << 22, 6_000_000])
def test_split(n):
    a, b, m = lf.split(n)
    assert a * b == m and a <= b <= lf.LARGEST and (m == n or m >= 2 * n - 1)
    assert m == n or all(n % d or n // d > lf.LARGEST for d in range(1, lf.LARGEST + 1) if d * lf.LARGEST >= n) or a == 1


def test_too_long():
    with pytest.raises(ValueError, match="too long"):
        lf.split(97 * 89, 16)


@pytest.mark.parametrize("block,largest", [(16, 8), (64, 16), (lf.BLOCK, lf.LARGEST)])
def test_transforms(spark, block, largest):
    rng = np.random.default_rng(block)
    sizes = [1, 2, 3, 5, 8, 16, 17, 24, 29, 31, 32, 36] + [60, 61, 64, 100, 127] * (largest > 8)
    records = {f"g{n}": rng.standard_normal(n) for n in sizes}
    got = lf.record_fft(table(spark, records), block=block, largest=largest).orderBy("group_id", "k").toPandas()
    assert len(got) == sum(sizes)
    for g, x in records.items():
        one = got[got.group_id == g]
        assert one.k.tolist() == list(range(len(x)))
        assert np.abs(one.re.to_numpy() + 1j * one.im.to_numpy() - np.fft.fft(x)).max() < 1e-9


def test_complex_records(spark):
    rng = np.random.default_rng(1)
    z = rng.standard_normal(53) + 1j * rng.standard_normal(53)
    s = spark.createDataFrame([("g", i, float(v.real), float(v.imag)) for i, v in enumerate(z)], "g string, n long, re double, im double")
    got = lf.record_fft(s, ["g"], block=32, largest=16).orderBy("k").toPandas()
    assert np.abs(got.re + 1j * got.im - np.fft.fft(z)).max() < 1e-9


def test_a_long_record(spark):
    """2^19 samples in blocks of 2^12: no group holds more, and NumPy agrees to 1e-9."""
    n = 1 << 19
    s = spark.range(n).select(F.lit("g").alias("group_id"), F.lit("L").alias("part"), F.col("id").alias("n"), (F.sin(F.col("id") * 0.37) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"))
    x = s.orderBy("n").toPandas().x.to_numpy()
    got = lf.record_fft(s, block=1 << 12, largest=1 << 10).orderBy("k").toPandas()
    want = np.fft.fft(x)
    assert np.abs(got.re.to_numpy() + 1j * got.im.to_numpy() - want).max() / np.abs(want).max() < 1e-9


@pytest.mark.parametrize("window", ["boxcar", "hann", "blackman"])
@pytest.mark.parametrize("detrend", ["none", "constant", "linear"])
def test_spectra_equal_those_of_windows(spark, window, detrend):
    rng = np.random.default_rng(3)
    records = {f"g{n}": rng.standard_normal(n) + np.arange(n) / 9 for n in (3, 8, 45, 64, 71)}
    s = table(spark, records)
    for density in (False, True):
        got = lf.record_spectrum(s, 50.0, window, detrend, density, block=64, largest=16).orderBy("group_id", "k").toPandas()
        for g, x in records.items():
            freqs, want = kernels.periodogram_batch(x[None], 50.0, window, None, detrend) if density else kernels.fft_batch(x[None], 50.0, None, window, detrend)
            one = got[got.group_id == g]
            assert np.allclose(one.freq_hz, freqs) and np.allclose(one.psd if density else one.magnitude, want[0], atol=1e-10), (g, density)


@pytest.mark.parametrize("lag,block", [(0, 8), (5, 8), (40, 16), (300, 64)])
def test_autocorrelations(spark, lag, block):
    rng = np.random.default_rng(lag)
    records = {f"g{n}": rng.standard_normal(n) for n in (1, 2, 41, 200, 1001)}
    got = lf.record_autocorrelation(table(spark, records), lag, block=block).orderBy("group_id", "lag").toPandas()
    for g, x in records.items():
        c = x - x.mean()
        want = [float(c[: len(c) - m] @ c[m:] / len(c)) for m in range(min(lag, len(c) - 1) + 1)]
        one = got[got.group_id == g]
        assert one.lag.tolist() == list(range(len(want))) and np.allclose(one.r, want, atol=1e-12)


def test_blackman_tukey_equals_that_of_windows(spark):
    rng = np.random.default_rng(5)
    records = {"a": rng.standard_normal(500), "b": rng.standard_normal(333)}
    got = lf.record_blackman_tukey(table(spark, records), 64.0, 60, block=100).orderBy("group_id", "k").toPandas()
    for g, x in records.items():
        freqs, want = kernels.blackman_tukey_batch(x[None], 64.0, 60)
        one = got[got.group_id == g]
        assert np.allclose(one.freq_hz, freqs) and np.allclose(one.psd, want[0], atol=1e-12)
    with pytest.raises(Exception, match="shorter than the lags"):
        lf.record_blackman_tukey(table(spark, {"c": [1.0, 2.0]}), 64.0, 60).collect()


@pytest.mark.parametrize("length,taps", [(20_000, 4097), (3000, 4097), (900, 129), (50, 200)])
def test_long_filters(spark, length, taps):
    rng = np.random.default_rng(taps)
    x, h = rng.standard_normal(length), rng.standard_normal(taps) / taps
    got = fi.apply_fir(table(spark, {"g": x}), h, block=1024).orderBy("n").toPandas()
    assert len(got) == length and np.allclose(got.y, np.convolve(x, h)[:length], atol=1e-12)


def test_lags_over_many_blocks(spark):
    """4,096 lags over a record of 32 blocks."""
    x = np.random.default_rng(9).standard_normal(131_072)
    got = lf.record_autocorrelation(table(spark, {"g": x}), 4096, block=4096).orderBy("lag").toPandas()
    c = x - x.mean()
    spectrum = np.abs(np.fft.rfft(c, 2 * len(c))) ** 2
    assert np.allclose(got.r, np.fft.irfft(spectrum)[:4097] / len(c), atol=1e-12)

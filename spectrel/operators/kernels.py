"""Spectra and the feature table by FFT in Arrow batches: for windows as arrays, without a shuffle. The same results as spectral.py and features.py
for real windows; complex windows give two-sided spectra in the order of their frequencies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spectrel.functions.windows import weights
from spectrel.operators.features import BASE_FEATURES, band_columns
from spectrel.operators.spectral import equal_bands


def detrended(x: np.ndarray, kind: str) -> np.ndarray:
    """x without the mean ("constant") or the least-squares line ("linear") of its last axis."""
    if kind == "none":
        return x
    x = x - x.mean(-1, keepdims=True)
    if kind == "linear":
        n = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
        x = x - (x @ n)[..., None] / max((n * n).sum(), 1e-300) * n
    return x


def two_sided_order(n_fft: int, fs: float) -> tuple[np.ndarray, np.ndarray]:
    freqs = np.fft.fftfreq(n_fft, 1 / fs)
    order = np.argsort(freqs)
    return order, freqs[order]


def fft_batch(x: np.ndarray, fs: float, n_fft: int | None = None, window: str = "boxcar", detrend: str = "none") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, magnitudes over the sum of the window's weights) of every row of x; interior ones of a one-sided spectrum doubled."""
    n_fft = n_fft or x.shape[1]
    w = np.array(weights(window, x.shape[1]))
    y, scale = detrended(x, detrend) * w, max(w.sum(), 1e-12)
    if np.iscomplexobj(x):
        order, freqs = two_sided_order(n_fft, fs)
        return freqs, np.abs(np.fft.fft(y, n_fft, axis=1))[:, order] / scale
    out = np.abs(np.fft.rfft(y, n_fft, axis=1)) / scale
    if out.shape[1] > 2:
        out[:, 1:-1] *= 2
    return np.arange(n_fft // 2 + 1) * (fs / n_fft), out


def density_batch(seg: np.ndarray, fs: float, window: str, n_fft: int | None = None, detrend: str = "constant") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, densities) of the segments along the last axis."""
    size = seg.shape[-1]
    n_fft = n_fft or size
    w = np.array(weights(window, size))
    y, norm = detrended(seg, detrend) * w, fs * (w * w).sum()
    if np.iscomplexobj(seg):
        order, freqs = two_sided_order(n_fft, fs)
        return freqs, (np.abs(np.fft.fft(y, n_fft, axis=-1)) ** 2 / norm)[..., order]
    spectrum = np.fft.rfft(y, n_fft, axis=-1)
    psd = (spectrum.real**2 + spectrum.imag**2) / norm
    psd[..., 1 : -1 if n_fft % 2 == 0 else None] *= 2
    return np.arange(n_fft // 2 + 1) * (fs / n_fft), psd


def periodogram_batch(x: np.ndarray, fs: float, window: str = "boxcar", n_fft: int | None = None, detrend: str = "constant") -> tuple[np.ndarray, np.ndarray]:
    return density_batch(x, fs, window, n_fft, detrend)


def welch_batch(x: np.ndarray, fs: float, nperseg: int, noverlap: int | None = None, window: str = "hann", detrend: str = "constant") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, densities) of every row of x: the mean of its segments'."""
    nperseg = min(nperseg, x.shape[1])
    noverlap = min(nperseg // 2 if noverlap is None else noverlap, nperseg - 1)
    seg = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=1)[:, :: nperseg - noverlap]
    freqs, psd = density_batch(seg, fs, window, None, detrend)
    return freqs, psd.mean(1)


def blackman_tukey_batch(x: np.ndarray, fs: float, max_lag: int | None = None, window: str = "blackman", n_fft: int | None = None, compat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, densities) from the weighted autocorrelation, as spectral.blackman_tukey()."""
    n = x.shape[1]
    lags = min(n - 1, n // 4) if max_lag is None else max_lag
    if not 1 <= lags < n:
        raise ValueError("the largest lag lies between 1 and the size less 1")
    n_fft = n_fft or 1 << max(1, (2 * lags).bit_length())
    spectrum = np.fft.rfft(detrended(x, "constant"), 2 * n, axis=1)
    r = np.fft.irfft(spectrum.real**2 + spectrum.imag**2, axis=1)[:, : lags + 1] / n
    w = np.array(weights(window, 2 * lags + 1))
    lag, k = np.arange(lags + 1)[:, None], np.arange((n_fft + 1) // 2)[None]
    shift = 2 * np.pi * k * lags / n_fft if compat else 0.0
    angle = 2 * np.pi * lag * k / n_fft
    table = w[lags:, None] * np.cos(angle + shift) + np.where(lag > 0, w[lags::-1, None] * np.cos(shift - angle), 0.0)
    return k[0] * (fs / n_fft), np.maximum(r @ table / fs, 0)


def spectrum_table(windows: DataFrame, value: str, of, keep: Sequence[str], column: str = "win", imaginary: str | None = None) -> DataFrame:
    """(keep, k, freq_hz, value) of windows (arrays of one length in `column`, with imaginary parts in another column): of(x) gives (frequencies, values)."""
    schema = T.StructType([*[windows.schema[c] for c in keep], T.StructField("k", T.LongType()), T.StructField("freq_hz", T.DoubleType()), T.StructField(value, T.DoubleType())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x = array_matrix(b, column)
                freqs, v = of(x + 1j * array_matrix(b, imaginary) if imaginary else x)
                i = pa.array(np.repeat(np.arange(len(v)), len(freqs)))
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(i) for c in keep], pa.array(np.tile(np.arange(len(freqs)), len(v))), pa.array(np.tile(freqs, len(v))), pa.array(v.reshape(-1))], names=schema.names)

    return windows.select(*keep, column, *[imaginary] * bool(imaginary)).mapInArrow(run, schema)


def array_matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def spectrum_arrays(windows: DataFrame, value: str, of, keep: Sequence[str], column: str = "win") -> DataFrame:
    """(keep, value): the same with a window's values as an array."""
    schema = T.StructType([*[windows.schema[c] for c in keep], T.StructField(value, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                _, v = of(array_matrix(b, column))
                lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), np.ascontiguousarray(v).reshape(-1))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], names=schema.names)

    return windows.select(*keep, column).mapInArrow(run, schema)


def welch_arrays(windows: DataFrame, fs: float, nperseg: int = 256, noverlap: int | None = None, window: str = "hann", keep: Sequence[str] = ("window_id",), column: str = "win") -> DataFrame:
    return spectrum_arrays(windows, "psd", lambda x: welch_batch(x, fs, nperseg, noverlap, window), keep, column)


def fft_table(windows: DataFrame, fs: float, n_fft: int | None = None, window: str = "boxcar", detrend: bool = False, keep: Sequence[str] = ("window_id",), column: str = "win", imaginary: str | None = None) -> DataFrame:
    return spectrum_table(windows, "magnitude", lambda x: fft_batch(x, fs, n_fft, window, "linear" if detrend else "none"), keep, column, imaginary)


def periodogram_table(windows: DataFrame, fs: float, window: str = "boxcar", n_fft: int | None = None, keep: Sequence[str] = ("window_id",), column: str = "win", imaginary: str | None = None) -> DataFrame:
    return spectrum_table(windows, "psd", lambda x: periodogram_batch(x, fs, window, n_fft), keep, column, imaginary)


def welch_table(windows: DataFrame, fs: float, nperseg: int = 256, noverlap: int | None = None, window: str = "hann", keep: Sequence[str] = ("window_id",), column: str = "win", imaginary: str | None = None) -> DataFrame:
    return spectrum_table(windows, "psd", lambda x: welch_batch(x, fs, nperseg, noverlap, window), keep, column, imaginary)


def blackman_tukey_table(windows: DataFrame, fs: float, max_lag: int | None = None, window: str = "blackman", n_fft: int | None = None, compat: bool = False, keep: Sequence[str] = ("window_id",), column: str = "win") -> DataFrame:
    return spectrum_table(windows, "psd", lambda x: blackman_tukey_batch(x, fs, max_lag, window, n_fft, compat), keep, column)


def band_matrix(freqs: np.ndarray, bands: Sequence[tuple[float, float]]) -> np.ndarray:
    """What each density contributes to each band: band powers are densities @ matrix."""
    out = np.zeros((len(freqs), len(bands)))
    for j, (a, b) in enumerate(bands):
        lo, hi = np.maximum(freqs[:-1], a), np.minimum(freqs[1:], b)
        span, step = np.maximum(hi - lo, 0), np.diff(freqs)
        right = ((lo + hi) / 2 - freqs[:-1]) / step * span
        out[1:, j] += np.where(span > 0, right, 0)
        out[:-1, j] += np.where(span > 0, span - right, 0)
    return out


def features_batch(x: np.ndarray, fs: float, band_count: int, nperseg: int, window: str = "hann", noverlap: int | None = None) -> np.ndarray:
    """The features of every row of x, in the order of BASE_FEATURES, absolute and relative band powers."""
    w = np.array(weights(window, x.shape[1]))
    power = (x * x).mean(1)
    rms, top = np.sqrt(power), np.abs(x).max(1)
    magnitude = np.abs(np.fft.rfft(x * w, axis=1)) / max(w.sum(), 1e-12)
    magnitude[:, 1:-1] *= 2
    freqs, psd = welch_batch(x, fs, nperseg, noverlap, window)
    psd = np.nan_to_num(psd, nan=0.0, posinf=0.0, neginf=0.0)
    s0, s1 = psd.sum(1), psd @ freqs
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = np.where(s0 > 0, s1 / s0, 0.0)
        spread = np.where(s0 > 0, (psd @ (freqs * freqs)) / s0 - centre**2, 0.0)
        crest = np.where(rms > 0, top / rms, 0.0)
    bands = np.maximum(psd @ band_matrix(freqs, equal_bands(fs, band_count)), 0)
    area = np.maximum(((psd[:, 1:] + psd[:, :-1]) / 2 * np.diff(freqs)).sum(1), 0)
    fft_hz = np.argmax(np.round(magnitude, 12), axis=1) * (fs / x.shape[1])
    base = [rms, power, (x * x).sum(1), top, crest, fft_hz, freqs[np.argmax(np.round(psd, 12), axis=1)], psd.max(1), area, centre, np.sqrt(np.maximum(spread, 0))]
    return np.column_stack([*base, bands, bands / np.maximum(bands.sum(1, keepdims=True), 2.220446049250313e-16)])


def feature_table(windows: DataFrame, fs: float, band_count: int = 20, nperseg: int = 256, window: str = "hann", column: str = "win", noverlap: int | None = None) -> DataFrame:
    """windows (arrays of one length in `column`) with the features in its place."""
    names = [*BASE_FEATURES, *band_columns(band_count, False), *band_columns(band_count)]
    rest = [c for c in windows.columns if c != column]
    schema = T.StructType([*[windows.schema[c] for c in rest], *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                f = features_batch(array_matrix(b, column), fs, band_count, nperseg, window, noverlap)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(f[:, j]) for j in range(f.shape[1])], names=rest + names)

    return windows.select(*rest, column).mapInArrow(run, schema)

"""Spectra of whole records that no task holds: the four-step Fourier transform over two shuffles.

A record of N = a * b samples is a matrix of a rows and b columns, sample n at row n div b and column n mod b. Blocks of whole columns are transformed
along the columns and multiplied by twiddles; blocks of whole rows are transformed along the rows, and row k1, place k2 is frequency k1 + a * k2. A
block has about BLOCK numbers, or one column or row; samples go as arrays, and Python takes many blocks a batch, so that short records cost no call each. A length that doesn't split into factors that small (a prime, say) goes through a longer transform whose
length is a power of two: the transform as a convolution with a chirp.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.functions.columns import ratio, require_columns
from spectrel.functions.tables import written
from spectrel.functions.windows import COSINES, weights, window_name
from spectrel.operators.conditioning import RECORD, by_record
from spectrel.operators.framing import blocks

#: Numbers of a block, and the longest column or row that a task may hold.
BLOCK, LARGEST = 1 << 16, 1 << 17
#: The longest record: n * n has to fit in 64 bits for the chirp.
MOST = 3_000_000_000
#: Numbers that a task gets to transform, and that it sends on in one batch.
NUMBERS, SENT = 1 << 20, 1 << 18


def split(n: int, largest: int = LARGEST) -> tuple[int, int, int]:
    """(a, b, m): the factors of the transform's length m = a * b: of n itself if it has a pair with both up to `largest`, else of the power of two that a
    convolution of this length needs."""
    if n <= largest:
        return 1, max(1, n), max(1, n)
    for a in range(math.isqrt(n), 0, -1):
        if n // a > largest:
            break
        if n % a == 0:
            return a, n // a, n
    m = 1 << (2 * n - 2).bit_length()
    a = 1 << (m.bit_length() - 1) // 2
    if m // a > largest or n > MOST:
        raise ValueError(f"a record of {n} samples is too long for columns of {largest}")
    return a, m // a, m


def sized(lengths: DataFrame, largest: int) -> DataFrame:
    """lengths (keys, size, what else a record has) with a_, b_, m_ of split(), a row a record."""

    @F.pandas_udf("a long, b long, m long")
    def parts(size: pd.Series) -> pd.DataFrame:
        known = {n: split(int(n), largest) for n in size.unique()}
        return pd.DataFrame([known[n] for n in size], columns=["a", "b", "m"])

    return lengths.withColumn("p_", parts("size")).select(*lengths.columns, F.col("p_.a").alias("a_"), F.col("p_.b").alias("b_"), F.col("p_.m").alias("m_"))


def typed(df: DataFrame, names: Sequence[str]) -> str:
    """names with df's types, as a schema."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{k}` {kinds[k]}, " for k in names)


def listed(parts: Sequence[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(np.concatenate(parts)))


def packed(t: pa.RecordBatch, held: Sequence[str], names: Sequence[str], out: list[tuple]) -> pa.RecordBatch:
    """Rows of t's columns `held` at the places that out's tuples begin with, and of the tuples' numbers and arrays."""
    at, *columns = zip(*out, strict=True)
    made = [listed(c) if isinstance(c[0], np.ndarray) else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays([*[t.column(k).take(pa.array(at, pa.int64())) for k in held], *made], names=[*held, *names])


def limited(out: Iterator[tuple[pa.RecordBatch, tuple]], held: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (t, tuple as for packed()), of some SENT numbers."""
    rows, n, last = [], 0, None
    for t, row in out:
        if rows and (t is not last or n > SENT):
            yield packed(last, held, names, rows)
            rows, n = [], 0
        last = t
        rows.append(row)
        n += sum(len(c) for c in row if isinstance(c, np.ndarray))
    if rows:
        yield packed(last, held, names, rows)


def numbers(t: pa.RecordBatch, re: str = "re", im: str = "im") -> list[np.ndarray]:
    """The complex numbers of each row of t; an empty array im is zero."""
    (x, at), (y, to) = ((c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (t.column(re), t.column(im)))
    return [x[at[i] : at[i + 1]] + 1j * y[to[i] : to[i + 1]] if to[i + 1] > to[i] else x[at[i] : at[i + 1]] for i in range(t.num_rows)]


def groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Whole groups of rows that are sorted by `by`, and where each begins and the last one ends; one may go over several batches."""
    held = None
    for t in batches:
        if t.num_rows == 0:
            continue
        if held is not None:
            t = pa.Table.from_batches([held, t]).combine_chunks().to_batches()[0]
        codes = [t.column(k).dictionary_encode("encode").indices.to_numpy() for k in by]
        new = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist()
        if new:
            yield t.slice(0, new[-1]), [0, *new]
        held = t.slice(new[-1]) if new else t
    if held is not None:
        yield held, [0, held.num_rows]


def dealt(rows: DataFrame, held: int, by: Sequence[str]) -> DataFrame:
    """rows, those of a group side by side, by as many tasks as `held` numbers fill."""
    tasks = math.ceil(held / NUMBERS)
    few = tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(*by) if few else rows.repartition(tasks, *by)).sortWithinPartitions(*by)


def runs(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, count_, sum_, turn_, re, im): neighbouring samples of a record that stand in one batch as arrays from sample n on, with the sums of x and n x;
    im is empty where samples are real. What is sorted by record before has a row or two a record here, and samples in any order have a row each at most."""
    keys = list(keys)
    real = "x" in points.columns

    def gather(batches):
        for t in batches:
            if t.num_rows == 0:
                continue
            ids = np.zeros(t.num_rows, dtype=np.int64)
            for k in keys:
                codes = t.column(k).dictionary_encode("encode")
                ids = ids * (len(codes.dictionary) + 1) + codes.indices.to_numpy()
            n = t.column("n").to_numpy()
            order = np.lexsort((n, ids))
            ids, n = ids[order], n[order]
            x, *y = (t.column(c).to_numpy(zero_copy_only=False)[order] for c in (["x"] if real else ["re", "im"]))
            new = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (n[1:] != n[:-1] + 1)) + 1])
            ends = np.append(new, len(n)).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)), pa.ListArray.from_arrays(pa.array(np.zeros_like(ends) if real else ends), pa.array(y[0] if y else x[:0]))]
            sums = [np.add.reduceat(x, new), np.add.reduceat(x * n, new)]
            firsts = pa.array(order[new])
            yield pa.RecordBatch.from_arrays([*[t.column(k).take(firsts) for k in keys], pa.array(n[new]), pa.array(np.diff(ends).astype(np.int64)), *map(pa.array, sums), *arrays], names=[*keys, "n", "count_", "sum_", "turn_", "re", "im"])

    columns = [F.col("x").cast("double").alias("x")] if real else [F.col(c).cast("double").alias(c) for c in ("re", "im")]
    picked = points.select(*keys, F.col("n").cast("long").alias("n"), *columns)
    return picked.mapInArrow(gather, typed(points, keys) + "n long, count_ long, sum_ double, turn_ double, re array<double>, im array<double>")


FACTS = ("size", "mean_", "slope_", "a_", "b_", "m_")
CARRIED = ("size", "a_", "b_", "m_")
PIECES = "first_ long, re array<double>, im array<double>"


def angles(n: np.ndarray, size: int) -> np.ndarray:
    """The chirp's: pi n^2 / size."""
    return (n * n % (2 * size)) * (math.pi / size)


def places(n: int, count: int, b: int, first: int, w: int) -> np.ndarray:
    """Which of the samples from n on stand in a matrix's columns from `first` on."""
    at = (np.arange(n // b, (n + count - 1) // b + 1)[:, None] * b + np.arange(first, first + w)).reshape(-1)
    return at[(at >= n) & (at < n + count)]


def column_pieces(cut: DataFrame, keys: Sequence[str], held: int, block: int, window: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """Of runs with their records' FACTS: (keys, CARRIED, rows_, first_, re, im), the rows of blocks of whole columns that are transformed, by block of rows."""
    keys = list(keys)
    names = ["n", "count_", "block_", "re", "im"]

    def pieces(t):
        a, b, n, count = (t.column(c).to_numpy() for c in ("a_", "b_", "n", "count_"))
        for i, x in enumerate(numbers(t)):
            width = max(1, block // int(a[i]))
            for nr in range(-(-int(b[i]) // width)):
                first = nr * width
                at = places(int(n[i]), int(count[i]), int(b[i]), first, min(width, int(b[i]) - first))
                if len(at):
                    z = x[at - n[i]]
                    yield t, (i, int(n[i]), int(count[i]), nr, z.real, z.imag if z.dtype == complex else z[:0])

    def cutting(batches):
        yield from limited((one for t in batches for one in pieces(t)), [*keys, *FACTS], names)

    p, q, r = window

    def transformed(t, bounds):
        facts = [t.column(c).to_numpy() for c in (*FACTS, "n", "count_", "block_")]
        values = numbers(t)
        for s, e in itertools.pairwise(bounds):
            size, mean, slope, a, b, m, _, _, nr = (f[s].item() for f in facts)
            width = max(1, block // a)
            first, w = nr * width, min(width, b - nr * width)
            x = np.zeros(a * w, dtype=complex)
            for i in range(s, e):
                at = places(facts[6][i].item(), facts[7][i].item(), b, first, w)
                z = values[i] - mean - slope * (at - (size - 1) / 2)
                if (q, r) != (0.0, 0.0):
                    turn = at * (2 * math.pi / size)
                    z = z * (p - q * np.cos(turn) + r * np.cos(2 * turn))
                x[at // b * w + at % b - first] = z * np.exp(-1j * angles(at, size)) if m != size else z
            y = np.fft.fft(x.reshape(a, w), axis=0)
            y *= np.exp((-2j * np.pi / m) * (np.arange(a)[:, None] * np.arange(first, first + w)[None] % m))
            yield from ((t, (s, *one)) for one in row_pieces(y, first, b, block))

    def columns(batches):
        yield from limited((one for t, bounds in groups(batches, [*keys, "block_"]) for one in transformed(t, bounds)), [*keys, *CARRIED], ["rows_", "first_", "re", "im"])

    kinds = typed(cut, [*keys, *FACTS])
    blocks_ = dealt(cut.mapInArrow(cutting, kinds + "n long, count_ long, block_ long, re array<double>, im array<double>"), held, [*keys, "block_"])
    return blocks_.mapInArrow(columns, typed(cut, [*keys, *CARRIED]) + "rows_ long, " + PIECES)


def row_pieces(y: np.ndarray, first: int, b: int, block: int) -> Iterator[tuple]:
    """(rows_, first_, re, im): columns from `first` on, cut into the blocks of rows of a matrix of b columns."""
    high = max(1, block // b)
    for i in range(0, len(y), high):
        part = y[i : i + high].reshape(-1)
        yield i // high, first, part.real, part.imag


def whole_rows(pieces: DataFrame, keys: Sequence[str], held: int, block: int, ends: Callable[..., Iterator[tuple]], names: Sequence[str], schema: str) -> DataFrame:
    """Blocks of whole rows, transformed along them: what ends(first row, y, size, a, m) makes of each, with the columns `names`."""
    keys = list(keys)

    def transformed(t, bounds):
        size, a, b, m, nr, first = (t.column(c).to_numpy() for c in (*CARRIED, "rows_", "first_"))
        values = numbers(t)
        for s, e in itertools.pairwise(bounds):
            wide, high = int(b[s]), max(1, block // int(b[s]))
            h = min(high, int(a[s]) - int(nr[s]) * high)
            x = np.zeros((h, wide), dtype=complex)
            for i in range(s, e):
                z = values[i].reshape(h, -1)
                x[:, first[i] : first[i] + z.shape[1]] = z
            yield from ((t, (s, *one)) for one in ends(int(nr[s]) * high, np.fft.fft(x, axis=1), int(size[s]), int(a[s]), int(m[s])))

    def across(batches):
        yield from limited((one for t, bounds in groups(batches, [*keys, "rows_"]) for one in transformed(t, bounds)), [*keys, *CARRIED, "rows_"], names)

    return dealt(pieces, held, [*keys, "rows_"]).mapInArrow(across, typed(pieces, [*keys, *CARRIED, "rows_"]) + schema)


def spectra(r: DataFrame, facts: DataFrame, keys: Sequence[str], block: int = BLOCK, window: tuple[float, float, float] = (1.0, 0.0, 0.0), half: bool = False) -> DataFrame:
    """(keys, size, k, re, im), k, re and im as arrays, some rows a record: the transforms of the records whose runs are r, weighted by the cosine window and
    without their lines; facts (keys, FACTS) of those to be transformed. half: only frequencies up to size / 2."""
    keys = list(keys)

    def final(row, y, size, a, m):
        k = np.arange(row, row + len(y))[:, None] + a * np.arange(y.shape[1])[None]
        kept = k <= size // 2 if half else k < size
        k, y = k[kept], y[kept]
        if m != size:  # back from the chirp; the transform was that of the conjugate
            y = np.conj(y) / m * np.exp(-1j * angles(k, size))
        if len(k):
            yield k, y.real, y.imag

    def plain(row, y, size, a, m):
        y = y.reshape(-1)
        yield y.real, y.imag

    out = ["k", "re", "im"], "k array<long>, re array<double>, im array<double>"
    raw = ["re", "im"], "re array<double>, im array<double>"
    odd = F.col("m_") != F.col("size")
    total = facts.agg(F.sum(F.when(odd, 0).otherwise(F.col("m_"))), F.sum(F.when(odd, F.col("m_")).otherwise(0))).first()
    of = lambda chosen: r.select(*keys, "n", "count_", "re", "im").join(by_record(facts.where(chosen)), keys)
    direct = whole_rows(column_pieces(of(~odd), keys, total[0] or 0, block, window), keys, total[0] or 0, block, final, *out).select(*keys, "size", "k", "re", "im")
    if not total[1]:
        return direct
    # x[n] w[n], convolved with the conjugate chirp, times w[k], where w[n] = exp(-i pi n^2 / N); the chirp's transform is that of a length, for all its records
    lengths = written(facts.where(odd).select(F.col("size").alias("of_"), "a_", "b_", "m_").distinct(), "lengths")
    steps = F.sequence(F.lit(0).cast("long"), F.col("m_") - 1, F.lit(block).cast("long"))
    cut = lengths.select("of_", F.col("m_").alias("size"), F.lit(0.0).alias("mean_"), F.lit(0.0).alias("slope_"), "a_", "b_", "m_", F.explode(steps).alias("n")).repartition("of_", "n")

    def chirp(batches):
        for t in batches:
            rows = []
            for i, (size, m, n) in enumerate(zip(*(t.column(c).to_pylist() for c in ("of_", "m_", "n")), strict=True)):
                at = np.arange(n, min(m, n + block))
                back = np.minimum(at, m - at)  # from both ends
                z = np.where(back < size, np.exp(1j * angles(np.minimum(back, size), size)), 0)
                rows.append((t, (i, n, len(at), z.real, z.imag)))
            yield from limited(iter(rows), ["of_", *FACTS], ["n", "count_", "re", "im"])

    cut = cut.mapInArrow(chirp, typed(cut, ["of_", *FACTS]) + "n long, count_ long, re array<double>, im array<double>")
    every = lengths.agg(F.sum("m_")).first()[0]
    chirps = written(whole_rows(column_pieces(cut, ["of_"], every, block), ["of_"], every, block, plain, *raw).select(F.col("of_").alias("size"), "rows_", F.col("re").alias("c"), F.col("im").alias("s")), "chirps")
    there = whole_rows(column_pieces(of(odd), keys, total[1], block, window), keys, total[1], block, plain, *raw).join(chirps, ["size", "rows_"])

    def product(t):
        a, b, m, nr = (t.column(c).to_pylist() for c in ("a_", "b_", "m_", "rows_"))
        for i, (x, c) in enumerate(zip(numbers(t), numbers(t, "c", "s"), strict=True)):
            first = nr[i] * max(1, block // b[i])
            # a row of the transform holds frequencies that are a apart: a column of the matrix of b rows and a columns
            y = np.fft.fft(np.conj(x * c).reshape(-1, b[i]), axis=1).T
            y *= np.exp((-2j * np.pi / m[i]) * (np.arange(b[i])[:, None] * np.arange(first, first + y.shape[1])[None] % m[i]))
            yield from ((t, (i, b[i], a[i], *one)) for one in row_pieces(y, first, a[i], block))

    def turned(batches):
        yield from limited((one for t in batches for one in product(t)), [*keys, "size", "m_"], ["a_", "b_", "rows_", "first_", "re", "im"])

    back = there.mapInArrow(turned, typed(there, [*keys, "size", "m_"]) + "a_ long, b_ long, rows_ long, " + PIECES)
    return direct.unionByName(whole_rows(back, keys, total[1], block, final, *out).select(*keys, "size", "k", "re", "im"))


def record_fft(points: DataFrame, keys: Sequence[str] = RECORD, lengths: DataFrame | None = None, block: int = BLOCK, largest: int = LARGEST) -> DataFrame:
    """(keys, k, re, im): the discrete Fourier transform of every record, as long as the record. points: (keys, n, x) or (keys, n, re, im), n from 0 without
    gaps. lengths: (keys, size), else counted."""
    keys = list(keys)
    require_columns(points, [*keys, "n"])
    r = written(runs(points, keys), "runs")
    if lengths is None:
        lengths = r.groupBy(*keys).agg(F.sum("count_").alias("size"))
    zero = F.lit(0.0)
    facts = written(sized(lengths.select(*keys, "size", zero.alias("mean_"), zero.alias("slope_")), largest), "sizes")
    out = spectra(r, facts, keys, block).select(*keys, F.explode(F.arrays_zip("k", "re", "im")).alias("z"))
    return out.select(*keys, "z.k", "z.re", "z.im")


def window_sums(window: str, size: Column) -> tuple[Column, Column]:
    """(sum, sum of squares) of a window's weights over its length, closed for cosine windows from 8 samples on."""
    a, b, c = COSINES[window_name(window)]
    one, two = size * a, size * (a * a + b * b / 2 + c * c / 2)
    for n in range(1, 8):
        w = weights(window, n)
        one = F.when(size == n, math.fsum(w)).otherwise(one)
        two = F.when(size == n, math.fsum(x * x for x in w)).otherwise(two)
    return one, two


def record_spectrum(samples: DataFrame, fs: float, window: str = "boxcar", detrend: str = "none", density: bool = False, keys: Sequence[str] = RECORD, block: int = BLOCK, largest: int = LARGEST, least: int = 1) -> DataFrame:
    """(keys, k, freq_hz, magnitude or psd): the one-sided spectrum of every whole record (keys, n, x) of `least` samples or more, as kernels.fft_batch and
    periodogram_batch give them for windows. detrend: none, constant or linear, from sums of the record."""
    keys = list(keys)
    if detrend not in ("none", "constant", "linear"):
        raise ValueError(f"unknown detrending: {detrend}")
    require_columns(samples, [*keys, "n", "x"])
    r = written(runs(samples.select(*keys, "n", "x"), keys), "runs")
    size = F.col("size")
    sums = r.groupBy(*keys).agg(F.sum("count_").alias("size"), F.sum("sum_").alias("sum_"), F.sum("turn_").alias("turn_")).where(size >= least)
    # over n = 0 .. size - 1: its mean is (size - 1) / 2, its variance (size^2 - 1) / 12
    slope = ratio((F.col("turn_") - F.col("sum_") * (size - 1) / 2) / size, (size * size.cast("double") - 1) / 12)
    mean = F.lit(0.0) if detrend == "none" else F.col("sum_") / size
    facts = written(sized(sums.select(*keys, "size", mean.alias("mean_"), (slope if detrend == "linear" else F.lit(0.0)).alias("slope_")), largest), "records")
    one, two = window_sums(window, size)
    out = spectra(r, facts, keys, block, COSINES[window_name(window)], half=True)
    out = out.select(*keys, "size", (two if density else one).alias("sum_"), F.explode(F.arrays_zip("k", "re", "im")).alias("z"))
    k, half = F.col("z.k"), F.floor(size / 2)
    power = F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")
    if density:
        inner = (k > 0) & (2 * k != size)
        value = (F.when(inner, 2.0).otherwise(1.0) * power / (fs * F.col("sum_"))).alias("psd")
    else:
        inner = (k > 0) & (k < half)
        value = (F.when(inner, 2.0).otherwise(1.0) * F.sqrt(power) / F.greatest(F.col("sum_"), F.lit(1e-12))).alias("magnitude")
    return out.select(*keys, k.alias("k"), (k * fs / size).alias("freq_hz"), value)


def record_autocorrelation(samples: DataFrame, max_lag: int, keys: Sequence[str] = RECORD, block: int = BLOCK) -> DataFrame:
    """(keys, r): the biased autocorrelation of every record without its mean, for lags from 0 to max_lag, or to the record's length less 1, as one array a record.
    Each block is multiplied with itself and the max_lag samples before it; the blocks' sums are added up by lag."""
    keys = list(keys)
    if max_lag < 0:
        raise ValueError("lags aren't negative")
    stats = samples.groupBy(*keys).agg(F.count("*").alias("size"), F.avg("x").alias("mean_"))
    cut = blocks(samples, max(block, max_lag + 1), max_lag, keys).join(stats, keys)
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                nr, mean = b.column("block")[0].as_py(), b.column("mean_")[0].as_py()
                x = b.column("x").flatten().to_numpy(zero_copy_only=False) - mean
                skip = 0 if nr == 0 else max_lag
                n = 1 << int(2 * len(x) - 1).bit_length()
                own = np.where(np.arange(len(x)) >= skip, x, 0.0)
                r = np.fft.irfft(np.fft.rfft(own, n) * np.conj(np.fft.rfft(x, n)), n)[: max_lag + 1]
                r[len(x) :] = 0
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("size"), pa.array([r], pa.list_(pa.float64()))], names=[*keys, "size", "r"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "size long", "r array<double>"])
    parts = cut.mapInArrow(run, schema).select(*keys, "size", F.posexplode("r").alias("lag", "r"))
    sums = parts.where("lag < size").groupBy(*keys, "lag").agg((F.sum("r") / F.max("size")).alias("r"))
    return sums.select(*keys, F.col("lag").cast("long").alias("lag"), "r")


def record_blackman_tukey(samples: DataFrame, fs: float, max_lag: int, window: str = "blackman", n_fft: int | None = None, keys: Sequence[str] = RECORD, block: int = BLOCK) -> DataFrame:
    """(keys, k, freq_hz, psd) of whole records from their weighted autocorrelations, not below 0, for the non-negative frequencies but the last of an even
    n_fft. A record has max_lag + 1 samples or more."""
    keys = list(keys)
    n_fft = n_fft or 1 << max(1, (2 * max_lag).bit_length())
    if n_fft < 2 * max_lag + 1:
        raise ValueError("n_fft holds all lags of both signs")
    r = record_autocorrelation(samples, max_lag, keys, block)
    row = r.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda v: v["r"]).alias("r"))  # max_lag + 1 numbers a record
    kinds = {f.name: f.dataType.simpleString() for f in row.schema.fields}
    w = np.array(weights(window, 2 * max_lag + 1))

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                one = b.column("r").flatten().to_numpy(zero_copy_only=False)
                if len(one) != max_lag + 1:
                    raise ValueError("a record is shorter than the lags")
                full = np.zeros(n_fft)
                full[: max_lag + 1] = one * w[max_lag:]
                full[n_fft - max_lag :] += (one * w[max_lag::-1])[:0:-1]
                psd = np.maximum(np.fft.fft(full).real[: (n_fft + 1) // 2] / fs, 0)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array([psd], pa.list_(pa.float64()))], names=[*keys, "psd"])

    out = row.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "psd array<double>"])).select(*keys, F.posexplode("psd").alias("k", "psd"))
    return out.select(*keys, F.col("k").cast("long").alias("k"), (F.col("k") * (fs / n_fft)).alias("freq_hz"), "psd")

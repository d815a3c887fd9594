"""Digital filters: design on the driver from closed formulas, application to records, response and stability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.functions.windows import weights
from spectrel.operators.conditioning import RECORD
from spectrel.operators.framing import blocks

#: Other names of the kinds of filters.
KINDS = {"low": "lowpass", "high": "highpass", "passband": "bandpass", "band": "bandpass", "stop": "bandstop", "stopband": "bandstop", "notch": "bandstop"}


def kind_of(name: str) -> str:
    k = KINDS.get(name.lower(), name.lower())
    if k not in ("lowpass", "highpass", "bandpass", "bandstop"):
        raise ValueError(f"unknown kind of filter: {name}")
    return k


def edges(kind: str, fs: float, cutoff: float | Sequence[float]) -> list[float]:
    """The cutoffs as shares of half the rate."""
    c = [float(v) / (fs / 2) for v in (cutoff if isinstance(cutoff, Sequence) else [cutoff])]
    if len(c) != (2 if kind.startswith("band") else 1) or any(not 0 < v < 1 for v in c) or c != sorted(c):
        raise ValueError("cutoffs rise and lie between 0 and half the rate; bands have two")
    return c


def design_fir(kind: str, fs: float, cutoff: float | Sequence[float], numtaps: int = 101, window: str = "hamming") -> np.ndarray:
    """Windowed sinc with unit gain at the middle of the first passband."""
    kind = kind_of(kind)
    c = edges(kind, fs, cutoff)
    if kind in ("highpass", "bandstop") and numtaps % 2 == 0:
        raise ValueError("a filter that passes half the rate has an odd number of taps")
    bands = {"lowpass": [(0.0, c[0])], "highpass": [(c[0], 1.0)], "bandpass": [tuple(c)], "bandstop": [(0.0, c[0]), (c[-1], 1.0)]}[kind]
    m = np.arange(numtaps) - (numtaps - 1) / 2
    h = sum(b * np.sinc(b * m) - a * np.sinc(a * m) for a, b in bands) * np.array(weights(window, numtaps, symmetric=True))
    a, b = bands[0]
    middle = 0.0 if a == 0 else 1.0 if b == 1 else (a + b) / 2
    return h / (h * np.cos(math.pi * m * middle)).sum()


def _bessel_poles(order: int) -> np.ndarray:
    """Poles of the reverse Bessel polynomial, scaled to the phase norm."""
    c = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k)) for k in range(order + 1)]
    return np.roots(c[::-1]) / c[0] ** (1 / order)


def design_iir(kind: str, fs: float, cutoff: float | Sequence[float], order: int = 4, ftype: str = "butter") -> tuple[np.ndarray, np.ndarray]:
    """(b, a): an analog prototype, moved to the band, by the bilinear transform with prewarped edges."""
    kind = kind_of(kind)
    if ftype not in ("butter", "bessel"):
        raise ValueError("families with ripple need parameters that aren't given; butter and bessel are known")
    w = [4 * math.tan(math.pi * v / 2) for v in edges(kind, fs, cutoff)]
    p = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) if ftype == "butter" else _bessel_poles(order)
    z, gain = np.array([], dtype=complex), 1.0
    if kind == "lowpass":
        p, gain = p * w[0], w[0] ** order
    elif kind == "highpass":
        gain = float(np.real(1 / np.prod(-p)))
        p, z = w[0] / p, np.zeros(order, dtype=complex)
    else:
        middle, width = math.sqrt(w[0] * w[1]), w[1] - w[0]
        if kind == "bandpass":
            s = p * width / 2
            gain, z = width**order, np.zeros(order, dtype=complex)
        else:
            s = width / 2 / p
            gain, z = float(np.real(1 / np.prod(-p))), np.concatenate([np.full(order, 1j * middle), np.full(order, -1j * middle)])
        root = np.sqrt(s**2 - middle**2 + 0j)
        p = np.concatenate([s + root, s - root])
    gain = float(np.real(gain * np.prod(4 - z) / np.prod(4 - p)))
    z, p = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))]), (4 + p) / (4 - p)
    return gain * np.real(np.poly(z)), np.real(np.poly(p))


def zeros_and_poles(b: Sequence[float], a: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Roots in the z-plane; a shorter polynomial of the two counts as padded at its end."""
    b, a = np.trim_zeros(np.atleast_1d(np.asarray(b, dtype=float)), "f"), np.trim_zeros(np.atleast_1d(np.asarray(a, dtype=float)), "f")
    return np.roots(b), np.roots(a)


def is_stable(a: Sequence[float], tol: float = 0.0) -> bool:
    return len(np.atleast_1d(a)) <= 1 or bool(np.all(np.abs(np.roots(a)) < 1 - tol))


def expression(b: Sequence[float], a: Sequence[float]) -> str:
    """H(z) as text with six significant digits; terms that vanish are left out."""
    def side(c):
        terms = [f"{v:.6g}" + (f" z^-{i}" if i else "") for i, v in enumerate(np.atleast_1d(c)) if abs(v) > 1e-12]
        return " + ".join(terms).replace("+ -", "- ") or "0"

    return f"H(z) = ({side(b)}) / ({side(a)})"


def at_z(b: Sequence[float], a: Sequence[float], z: complex) -> complex:
    if abs(z) < 1e-12:
        raise ValueError("z is too near to zero")
    total = lambda c: sum(v * z ** (-i) for i, v in enumerate(np.atleast_1d(c)))
    return total(b) / total(a)


def frequency_response(spark: SparkSession, b: Sequence[float], a: Sequence[float], fs: float, points: int = 2048) -> DataFrame:
    """(k, freq_hz, re, im, magnitude) at `points` frequencies from 0 up to half the rate."""
    grid = spark.range(points).select(F.col("id").alias("k"), (F.col("id") * (math.pi / points)).alias("w"))

    def total(c, f):
        out = F.lit(0.0)
        for i, v in enumerate(np.atleast_1d(c)):
            out = out + float(v) * f(F.col("w") * float(i))
        return out

    g = grid.select("k", (F.col("k") * (fs / 2 / points)).alias("freq_hz"), total(b, F.cos).alias("br"), (-total(b, F.sin)).alias("bi"), total(a, F.cos).alias("ar"), (-total(a, F.sin)).alias("ai"))
    d = F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai")
    re, im = (F.col("br") * F.col("ar") + F.col("bi") * F.col("ai")) / d, (F.col("bi") * F.col("ar") - F.col("br") * F.col("ai")) / d
    return g.select("k", "freq_hz", re.alias("re"), im.alias("im"), F.sqrt(re * re + im * im).alias("magnitude"))


def designed(rows: DataFrame, keys: Sequence[str], of) -> DataFrame:
    """(keys, i, b, a): the coefficients of a filter for each of rows, from of(row), which gives (b, a); the shorter side is filled with zeros. Equal rows but for their keys are designed
    once a task."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def run(frames):
        known: dict[tuple, list[tuple[int, float, float]]] = {}
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                what = tuple(v for c, v in zip(frame.columns, row, strict=True) if c not in keys)
                if what not in known:
                    b, a = (np.atleast_1d(np.asarray(v, dtype=float)) for v in of(row))
                    n = max(len(b), len(a))
                    known[what] = list(zip(range(n), np.r_[b, np.zeros(n - len(b))].tolist(), np.r_[a, np.zeros(n - len(a))].tolist(), strict=True))
                out += [(*[getattr(row, k) for k in keys], *c) for c in known[what]]
            yield pd.DataFrame(out, columns=[*keys, "i", "b", "a"])

    return rows.mapInPandas(run, f"{own}, i int, b double, a double")


def responses(filters: DataFrame, keys: Sequence[str], fs: float, points: int) -> DataFrame:
    """(keys, k, freq_hz, re, im, magnitude) of many filters (keys, i, b, a), at `points` frequencies from 0 up to half the rate."""
    keys = list(keys)
    w = F.col("k") * (math.pi / points) * F.col("i")
    each = filters.select(*keys, "i", "b", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("k"))
    total = lambda c, f: F.sum(F.col(c) * f(w))
    g = each.groupBy(*keys, "k").agg(total("b", F.cos).alias("br"), (-total("b", F.sin)).alias("bi"), total("a", F.cos).alias("ar"), (-total("a", F.sin)).alias("ai"))
    d = F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai")
    re, im = (F.col("br") * F.col("ar") + F.col("bi") * F.col("ai")) / d, (F.col("bi") * F.col("ar") - F.col("br") * F.col("ai")) / d
    return g.select(*keys, "k", (F.col("k") * (fs / 2 / points)).alias("freq_hz"), re.alias("re"), im.alias("im"), F.sqrt(re * re + im * im).alias("magnitude"))


#: Samples of a block that one task filters at once.
BLOCK = 1 << 16


def samples_of(rows: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """(keys, n, columns) from blocks with start and arrays of one length."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    out = rows.select(*keys, "start", F.posexplode(zipped).alias("i", "v"))
    return out.select(*keys, (F.col("start") + F.col("i")).alias("n"), *[F.col("v")[c].alias(c) for c in columns])


#: From so many taps on, a block is convolved by FFT.
LONG_FIR = 128


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The convolution's first len(x) values; what the block's halo makes wrong at its start is dropped by the caller."""
    if len(h) < LONG_FIR:
        return np.convolve(x, h)
    n = 1 << int(len(x) + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def apply_fir(samples: DataFrame, taps: Sequence[float], keys: Sequence[str] = RECORD, block: int = BLOCK) -> DataFrame:
    """(keys, n, x, y): the causal convolution with the taps, zero before the start. Records are cut into blocks that hold the samples before
    them that the taps reach."""
    h = np.asarray(taps, dtype=float)
    reach = len(h) - 1
    cut = blocks(samples, max(block, reach + 1), reach, keys)
    schema = T.StructType([*[cut.schema[k] for k in keys], T.StructField("start", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x = one.column("x").flatten().to_numpy(zero_copy_only=False)
                skip = 0 if one.column("block")[0].as_py() == 0 else reach
                y = convolved(x, h)[skip : len(x)]
                yield pa.RecordBatch.from_arrays([*[one.column(k) for k in keys], pa.array([one.column("start")[0].as_py() + skip]), pa.array([x[skip:]], pa.list_(pa.float64())), pa.array([y], pa.list_(pa.float64()))], names=schema.names)

    return samples_of(cut.mapInArrow(run, schema), keys, "x", "y")


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The delays' content after a long run of ones."""
    n = max(len(a), len(b))
    a, b = np.r_[a, np.zeros(n - len(a))] / a[0], np.r_[b, np.zeros(n - len(b))] / a[0]
    m = np.eye(n - 1) - np.eye(n - 1, k=1)
    m[:, 0] += a[1:]
    return np.linalg.solve(m, b[1:] - a[1:] * b[0]) if n > 1 else np.empty(0)


class Recursion:
    """A filter as a state space in the transposed direct form. A run is cut into pieces of `piece` samples: what a piece makes of its samples and of
    the state before it are matrix products, and only states go from piece to piece."""

    def __init__(self, b: Sequence[float], a: Sequence[float], piece: int = 128):
        b, a = np.atleast_1d(np.asarray(b, dtype=float)), np.atleast_1d(np.asarray(a, dtype=float))
        n = max(len(a), len(b))
        a, b = np.r_[a, np.zeros(n - len(a))] / a[0], np.r_[b, np.zeros(n - len(b))] / a[0]
        self.order, self.piece, self.gain = n - 1, piece, b[0]
        self.step = np.eye(n - 1, k=1)
        self.step[:, :1] -= a[1:, None]
        self.enter = b[1:] - a[1:] * b[0]
        powers = [np.eye(n - 1)]
        for _ in range(piece):
            powers.append(self.step @ powers[-1])
        self.powers = powers
        self.leave = np.array([q[0] if n > 1 else [] for q in powers[:piece]]).reshape(piece, n - 1)
        self.gather = np.array([powers[piece - 1 - i] @ self.enter for i in range(piece)]).reshape(piece, n - 1)
        h = np.r_[self.gain, [self.leave[i] @ self.enter for i in range(piece - 1)]]
        self.inside = np.array([[h[i - j] if i >= j else 0.0 for j in range(piece)] for i in range(piece)])

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(y, the state after the last sample)."""
        d = np.zeros(self.order) if state is None else np.asarray(state, dtype=float)
        if not self.order or not len(x):
            return self.gain * np.asarray(x, dtype=float), d
        whole, rest = divmod(len(x), self.piece)
        cut = np.r_[x, np.zeros(self.piece - rest if rest else 0)].reshape(-1, self.piece)
        gathered, states = cut @ self.gather, np.empty((len(cut), self.order))
        for i in range(len(cut)):
            states[i] = d
            if i < whole:
                d = self.powers[-1] @ d + gathered[i]
        if rest:
            d = self.powers[rest] @ d + cut[-1, :rest] @ self.gather[self.piece - rest :]
        return (cut @ self.inside.T + states @ self.leave.T).reshape(-1)[: len(x)], d

    def run_many(self, xs: Sequence[np.ndarray], states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The same for many runs at once, each from its own state: the pieces of all of them are multiplied together."""
        sizes = np.array([len(x) for x in xs])
        if not self.order or not len(xs):
            return [self.gain * x for x in xs], states
        pieces = max(1, -(-int(sizes.max()) // self.piece))
        cut = np.zeros((len(xs), pieces * self.piece))
        for row, x in zip(cut, xs, strict=True):
            row[: len(x)] = x
        cut = cut.reshape(len(xs), pieces, self.piece)
        gathered, held = cut @ self.gather, np.empty((len(xs), pieces + 1, self.order))
        held[:, 0] = states
        for i in range(pieces):
            held[:, i + 1] = held[:, i] @ self.powers[-1].T + gathered[:, i]
        y = (cut @ self.inside.T + held[:, :pieces] @ self.leave.T).reshape(len(xs), -1)
        whole, rest = np.divmod(sizes, self.piece)
        ends = held[np.arange(len(xs)), whole].copy()
        for i in np.flatnonzero(rest):
            ends[i] = self.powers[rest[i]] @ ends[i] + cut[i, whole[i], : rest[i]] @ self.gather[self.piece - rest[i] :]
        return [v[:n] for v, n in zip(y, sizes, strict=True)], ends


def in_turns(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The places of runs, those of similar lengths together, so that filled up to the longest they have about `most` samples."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and int(sizes[order[end]]) * (end + 1 - at) <= most:
            end += 1
        yield order[at:end]
        at = end


def lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of lists."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(v) if v is not None else 0 for v in column)])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def list_column(values: Sequence[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.empty(0)])))


def lfilter(b: Sequence[float], a: Sequence[float], x: np.ndarray, zi: np.ndarray | None = None) -> np.ndarray:
    """The causal filter, from a state of the delays."""
    return Recursion(b, a).run(np.asarray(x, dtype=float), zi)[0]


def filtfilt(b: Sequence[float], a: Sequence[float], x: np.ndarray) -> np.ndarray:
    """Forward and backward over the signal extended oddly by three times the longer side; plain lfilter for short signals."""
    b, a = np.atleast_1d(np.asarray(b, dtype=float)), np.atleast_1d(np.asarray(a, dtype=float))
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        return lfilter(b, a, x)
    zi, run = steady_state(b, a), Recursion(b, a).run
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    y = run(y, zi * y[0])[0][::-1]
    return run(y, zi * y[0])[0][::-1][pad:-pad]


def apply_filter(recs: DataFrame, b: Sequence[float], a: Sequence[float] = (1.0,), zero_phase: bool = True, column: str = "x") -> DataFrame:
    """recs (a row a short record, samples as an array) with y, in Arrow batches; apply_iir() is for long records."""
    b, a = [float(v) for v in np.atleast_1d(b)], [float(v) for v in np.atleast_1d(a)]
    schema = T.StructType([*recs.schema.fields, T.StructField("y", T.ArrayType(T.DoubleType()))])

    def run(batches):
        f = filtfilt if zero_phase else lfilter
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column([f(b, a, x.astype(float)) for x in lists(batch.column(column))])], names=[*batch.schema.names, "y"])

    return recs.mapInArrow(run, schema)


def _carried(cut: DataFrame, b: Sequence[float], a: Sequence[float], keys: Sequence[str], order: str) -> DataFrame:
    """cut (keys, order, x, init) with y: each record's blocks filtered in the order as one run. init: the state before the first block.

    Every block's own end state is found first; a record's states, a row a block, are carried through; then the blocks are filtered with them."""
    n = max(len(b), len(a)) - 1
    states = T.ArrayType(T.DoubleType())
    ends = T.StructType([*[cut.schema[k] for k in keys], T.StructField(order, T.LongType()), T.StructField("size", T.LongType()), T.StructField("end", states), T.StructField("init", states)])

    f = Recursion(b, a)

    def end_states(batches):
        for batch in batches:
            xs, out = lists(batch.column("x")), np.empty((batch.num_rows, n))
            for at in in_turns(np.array([len(x) for x in xs])):
                out[at] = f.run_many([xs[i] for i in at], np.zeros((len(at), n)))[1]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column(order), pa.array([len(x) for x in xs], pa.int64()), list_column(list(out)), batch.column("init")], names=ends.names)

    def carry(table: pa.Table) -> pa.Table:
        table, out = table.sort_by(order), []
        d = np.array(table.column("init")[0].as_py() or [0.0] * n)
        known: dict[int, np.ndarray] = {}
        for size, end in zip(table.column("size").to_pylist(), table.column("end").to_pylist(), strict=True):
            out.append(d)
            if table.num_rows > 1:
                if size not in known:  # what a state becomes after so many samples of zero
                    known[size] = np.linalg.matrix_power(f.step, size)
                d = known[size] @ d + np.array(end)
        return pa.table({**{k: table.column(k) for k in keys}, order: table.column(order), "before": pa.array([v.tolist() for v in out], pa.list_(pa.float64()))})

    before = cut.mapInArrow(end_states, ends).groupBy(*keys).applyInArrow(carry, T.StructType([*[cut.schema[k] for k in keys], T.StructField(order, T.LongType()), T.StructField("before", states)]))
    both = cut.join(before, [*keys, order])
    schema = T.StructType([*[f for f in both.schema.fields if f.name not in ("before", "init")], T.StructField("y", states)])

    def filtered(batches):
        for batch in batches:
            xs, out = lists(batch.column("x")), [np.empty(0)] * batch.num_rows
            before = batch.column("before").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
            for at in in_turns(np.array([len(x) for x in xs])):
                for i, y in zip(at, f.run_many([xs[i] for i in at], before[at])[0], strict=True):
                    out[i] = y
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], list_column(out)], names=schema.names)

    return both.mapInArrow(filtered, schema)


def apply_iir(samples: DataFrame, b: Sequence[float], a: Sequence[float] = (1.0,), zero_phase: bool = True, keys: Sequence[str] = RECORD, block: int = BLOCK) -> DataFrame:
    """(keys, n, y) of records of any length, cut into blocks between which only the state of the delays is carried. zero_phase: forward and backward over
    the record extended oddly by three times the longer side; records that are no longer than that go forward only."""
    b, a = [float(v) for v in np.atleast_1d(b)], [float(v) for v in np.atleast_1d(a)]
    pad = 3 * max(len(a), len(b))
    cut = blocks(samples, max(block, pad + 2), 0, keys)
    alone = (F.col("blocks") == 1) & (F.size("x") <= pad) if zero_phase else F.lit(True)
    size = F.size("x")
    first, last = F.col("block") == 0, F.col("block") == F.col("blocks") - 1
    none = F.array().cast("array<double>")
    odd = lambda at, x: F.transform(x, lambda v: 2 * at - v)
    head = F.when(first & ~alone, odd(F.col("x")[0], F.reverse(F.slice("x", 2, pad)))).otherwise(none)
    tail = F.when(last & ~alone, odd(F.element_at("x", -1), F.reverse(F.slice("x", size - pad, F.lit(pad))))).otherwise(none)
    zi = steady_state(np.array(b), np.array(a)).tolist()
    rest = F.array(*[F.lit(v) for v in zi]) if zi else none
    ready = cut.select(*keys, "block", "blocks", "start", alone.alias("alone"), F.size(head).alias("head"), F.size(tail).alias("tail"), F.concat(head, "x", tail).alias("x"))
    forward = _carried(ready.withColumn("init", F.when(~F.col("alone"), F.transform(rest, lambda z: z * F.col("x")[0]))), b, a, keys, "block")
    if zero_phase:
        turned = forward.select(*keys, "block", "blocks", "start", "alone", "head", "tail", (F.col("blocks") - 1 - F.col("block")).alias("turn"), F.reverse("y").alias("x"), F.col("y").alias("once"))
        turned = turned.withColumn("init", F.when(~F.col("alone"), F.transform(rest, lambda z: z * F.col("x")[0])))
        back = _carried(turned, b, a, keys, "turn")
        forward = back.withColumn("y", F.when(F.col("alone"), F.col("once")).otherwise(F.reverse("y")))
    own = F.slice("y", F.col("head") + 1, F.size("y") - F.col("head") - F.col("tail"))
    return samples_of(forward.select(*keys, "start", own.alias("y")), keys, "y")

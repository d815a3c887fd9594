"""Records as arrays: sorted lines are packed where they are numbered, a piece of a record a row, and windows of several configurations are cut and turned
into features from the same pieces. A record's samples are never rows again, and no task holds a long record."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.operators import kernels
from spectrel.operators.conditioning import by_record
from spectrel.operators.features import BASE_FEATURES, FeatureConfig, band_columns, feature_columns

#: A piece's own samples, pieces that are cut into windows at once, and windows that are transformed at once.
PIECE, TOGETHER, WINDOWS = 1 << 14, 512, 4096


def _cut(x: np.ndarray, start: int, size: int, reach: int, last: bool) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray, int]:
    """([(start, own samples, samples with what the last windows reach to)], what is left, its start) of the samples of a record from start on, in pieces of
    `size`; with last nothing is left."""
    out = []
    while len(x) > size + reach:
        out.append((start, size, x[: size + reach]))
        x, start = x[size:], start + size
    if last:
        out.append((start, len(x), x))
        x, start = x[:0], start + len(x)
    return out, x, start


def pack(lines: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """(keys, start, own, whole, sum_, lo_, hi_, x) of lines (keys, x) that lie in order, a record in one partition: pieces of PIECE own samples with the `reach`
    samples after them, so that a window of up to reach + 1 samples lies in the piece in which it begins. whole: the piece is its record. A sample that isn't finite fails."""
    keys, size = list(keys), PIECE
    kinds = {"start": T.LongType(), "own": T.LongType(), "whole": T.BooleanType(), "sum_": T.DoubleType(), "lo_": T.DoubleType(), "hi_": T.DoubleType(), "x": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*[lines.schema[k] for k in keys], *[T.StructField(n, t) for n, t in kinds.items()]])

    def row(key: list[pa.Array], start: int, own: int, x: np.ndarray, whole: bool) -> pa.RecordBatch:
        mine = x[:own]
        return pa.RecordBatch.from_arrays([*key, pa.array([start]), pa.array([own]), pa.array([whole]), pa.array([mine.sum()]), pa.array([mine.min()]), pa.array([mine.max()]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], names=schema.names)

    def rows(key: list[pa.Array], start: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        pieces = _cut(x, start, size, reach, True)[0]
        for s, own, v in pieces:
            yield row(key, s, own, v, start == 0 and len(pieces) == 1)

    def run(batches) -> Iterator[pa.RecordBatch]:
        key, held, start = None, [], 0  # the record that may go on
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("x").to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                raise ValueError("a sample isn't finite")
            new = np.zeros(n - 1, dtype=bool)
            for k in keys:
                new |= pc.not_equal(b.column(k).slice(1), b.column(k).slice(0, n - 1)).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(new) + 1).tolist(), n]
            first = 0
            if key is not None:
                if all(k.equals(b.column(c).slice(0, 1)) for k, c in zip(key, keys, strict=True)):
                    held.append(x[: at[1]])
                    first = 1
                if len(at) > first + 1:  # another record follows
                    yield from rows(key, start, np.concatenate(held))
                    key = None
                elif sum(map(len, held)) > size + reach:
                    done, rest, start = _cut(np.concatenate(held), start, size, reach, False)
                    for s, own, v in done:
                        yield row(key, s, own, v, False)
                    held = [rest]
            if key is not None:
                continue
            ends = at[first:-1]  # where records that end in the batch begin, and the last record
            if len(ends) > 1:
                length = np.diff(ends)
                if length.max() <= size + reach:
                    v, o = x[ends[0] : ends[-1]], np.array(ends) - ends[0]
                    whole = pa.array(np.ones(len(length), dtype=bool))
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(ends[:-1])) for k in keys], pa.array(np.zeros(len(length), dtype=np.int64)), pa.array(length), whole, pa.array(np.add.reduceat(v, o[:-1])), pa.array(np.minimum.reduceat(v, o[:-1])), pa.array(np.maximum.reduceat(v, o[:-1])), pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v))], names=schema.names)
                else:
                    for i, j in zip(ends[:-1], ends[1:], strict=True):
                        yield from rows([b.column(k).slice(i, 1) for k in keys], 0, x[i:j])
            key, held, start = [b.column(k).slice(ends[-1], 1) for k in keys], [x[ends[-1] :]], 0
        if key is not None:
            yield from rows(key, start, np.concatenate(held))

    return lines.select(*keys, "x").mapInArrow(run, schema)


def with_facts(pieces: DataFrame, keys: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """pieces with the length, the mean and the scale (maxabs without the mean, as conditioning.preprocess) of their record. A whole record has them in its row; only
    records in several pieces are joined with theirs."""
    keys = list(keys)
    facts = lambda size, total, lo, hi: [size.cast("long").alias("length_"), (total / size).alias("mean_"), F.greatest(hi - total / size, total / size - lo, F.lit(eps)).alias("scale_")]
    own = [F.col("own"), F.col("sum_"), F.col("lo_"), F.col("hi_")]
    cut = pieces.where("not whole")
    by = cut.groupBy(*keys).agg(*facts(F.sum("own"), F.sum("sum_"), F.min("lo_"), F.max("hi_")))
    rest = [c for c in pieces.columns if c not in ("sum_", "lo_", "hi_")]
    return pieces.where("whole").select(*rest, *facts(*own)).unionByName(cut.select(*rest).join(by_record(by), keys))


def _windows(length: np.ndarray, start: np.ndarray, own: np.ndarray, config: FeatureConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, number, idx) of the windows that begin in the pieces, as framing.sampled_windows chooses them from records of these lengths."""
    size, hop, most = config.window_size, config.hop_size, config.windows_per_part
    c = np.where(length >= size, (length - size) // hop + 1, 0)
    count = np.minimum(c, most)
    piece = np.repeat(np.arange(len(c)), count)
    number = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    idx = number.copy()
    many = c[piece] > most
    if many.any():
        last = most - 1
        top = c[piece[many]] - 1
        idx[many] = np.where(number[many] == last, top if most > 1 else 0, np.floor(number[many] * (top / max(1, last))).astype(np.int64))
    on = (idx * hop >= start[piece]) & (idx * hop < start[piece] + own[piece])
    return piece[on], number[on], idx[on]


def conditioned(b: pa.RecordBatch, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(samples, offsets) of a batch of pieces: without the record's mean, over its scale, with 0.8 of a tone of hz_."""
    lists = b.column("x")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    x, size = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    offsets = offsets - offsets[0]
    each = lambda c: np.repeat(b.column(c).to_numpy(zero_copy_only=False), size)
    n = np.arange(len(x)) - np.repeat(offsets[:-1], size) + each("start")
    hz = each("hz_")
    return (x - each("mean_")) / each("scale_") + np.where(hz == 0, 0.0, 0.8 * np.sin(2 * math.pi * hz * (n / fs))), offsets


def _features(b: pa.RecordBatch, config: FeatureConfig, y: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, number, idx, features) of the windows of a batch of pieces, whose conditioned samples are y."""
    start = b.column("start").to_numpy()
    piece, number, idx = _windows(b.column("length_").to_numpy(), start, b.column("own").to_numpy(), config)
    at = offsets[piece] + idx * config.hop_size - start[piece]
    place = np.arange(config.window_size)
    out = [kernels.features_batch(y[at[i : i + WINDOWS, None] + place], config.fs, config.band_count, config.nperseg, config.window) for i in range(0, len(at), WINDOWS)]
    return piece, number, idx, np.concatenate(out) if out else np.zeros((0, len(BASE_FEATURES) + 2 * config.band_count))


def window_rows(pieces: DataFrame, keep: Sequence[str], config: FeatureConfig) -> DataFrame:
    """(keep, number, idx, start, stop, features): a row a window of pieces with their facts and hz_."""
    config.validate()
    names = [*BASE_FEATURES, *band_columns(config.band_count, False), *band_columns(config.band_count)]
    whole = [T.StructField(n, T.LongType()) for n in ("number", "idx", "start", "stop")]
    schema = T.StructType([*[pieces.schema[k] for k in keep], *whole, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        for all_ in batches:
            for i in range(0, all_.num_rows, TOGETHER):
                b = all_.slice(i, TOGETHER)
                piece, number, idx, f = _features(b, config, *conditioned(b, config.fs))
                start = idx * config.hop_size
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(piece)) for k in keep], *[pa.array(v) for v in (number, idx, start, start + config.window_size)], *[pa.array(f[:, j]) for j in range(f.shape[1])]], names=schema.names)

    return pieces.select(*dict.fromkeys([*keep, "start", "own", "length_", "mean_", "scale_", "hz_", "x"])).mapInArrow(run, schema)


def part_blocks(pieces: DataFrame, configs: Sequence[FeatureConfig], places: np.ndarray) -> DataFrame:
    """(t_, group_id, part, blocks_, n_, x_): a row a part and configuration (t_: its place) with all features of its windows, as learning.pack() gives them. places: a
    matrix from feature_columns() of a configuration to the columns of x_; configurations have one number of bands."""
    names = ["t_", "group_id", "part", "n_", "x_"]
    use = np.r_[: len(BASE_FEATURES), len(BASE_FEATURES) + configs[0].band_count : len(BASE_FEATURES) + 2 * configs[0].band_count]
    assert len(use) == len(feature_columns(configs[0].band_count)) == len(places)

    def run(batches):
        for all_ in batches:
            for i in range(0, all_.num_rows, TOGETHER):
                b = all_.slice(i, TOGETHER)
                y, offsets = conditioned(b, configs[0].fs)
                for t, config in enumerate(configs):
                    piece, _, _, f = _features(b, config, y, offsets)
                    x = np.ascontiguousarray(f[:, use] @ places)
                    count = np.bincount(piece, minlength=b.num_rows)
                    have = np.flatnonzero(count)
                    if len(have):
                        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count[have])] * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(have), t, dtype=np.int32)), b.column("group_id").take(pa.array(have)), b.column("part").take(pa.array(have)), pa.array(count[have].astype(np.int32)), lists], names=names)

    schema = "t_ int, group_id string, part string, n_ int, x_ array<double>"
    of = lambda p: p.select("group_id", "part", "start", "own", "length_", "mean_", "scale_", "hz_", "x").mapInArrow(run, schema)
    cut = of(pieces.where("not whole")).groupBy("t_", "group_id", "part").agg(F.sum("n_").cast("int").alias("n_"), F.flatten(F.collect_list("x_")).alias("x_"))
    return of(pieces.where("whole")).unionByName(cut).withColumn("blocks_", F.lit(1))


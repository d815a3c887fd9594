"""Exact medians of vectors, place by place, without a row for every value.

A double's bits, read as a whole number with the sign turned, are in the order of the doubles. The middle values of all places are found together, some bits at a time: a
pass counts, for every place, the values that share the bits found so far by their next bits, in one table a task; the counts are added up and tell the next bits. Six
passes of eleven bits tell all 64, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a pass finds.
BITS = 11


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    u = np.ascontiguousarray(x + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(u >= sign, ~u, u | sign)


def from_bits(u: np.ndarray) -> np.ndarray:
    sign = np.uint64(1 << 63)
    return np.where(u >= sign, u & ~sign, ~u).view(np.float64)


def vector_medians(rows: DataFrame, keys: Sequence[str], column: str, width: int) -> DataFrame:
    """(keys, n, column): the exact median of every place of the arrays in a column (all of `width` numbers; nulls are left out), by keys. For few keys: a task holds 32 KB for each place of each
    key that it meets, and as much comes to the driver for a key."""
    keys = list(keys)
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields]
    found = _quantiles(rows, keys, own, column, width, [0.5])
    out = [(*k, n, [float(v) for v in q[0]]) for k, n, q in found]
    return rows.sparkSession.createDataFrame(out, ", ".join([*own, "n long", f"`{column}` array<double>"]))


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> np.ndarray:
    """(shares, columns): exact quantiles of columns over all rows, between two values by their distance, as percentile() gives them; no task holds a column. NaN where there are no rows. Rows
    hold no nulls."""
    v = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    found = _quantiles(v, [], [], "v", len(columns), list(shares))
    return found[0][2] if found else np.full((len(shares), len(columns)), np.nan)


def _quantiles(rows: DataFrame, keys: list[str], own: list[str], column: str, width: int, shares: list[float]) -> list[tuple[tuple, int, np.ndarray]]:
    """For every key (its values, rows, quantiles by share and place)."""
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_"))
    slim = rows.where(F.col(column).isNotNull()).select(key.alias("key_"), F.col(column).cast("array<double>").alias("v_"))
    sizes = [(r["key_"], r["n"]) for r in slim.groupBy("key_").agg(F.count("*").alias("n")).collect()]  # a row a key
    number = {k: i for i, (k, _) in enumerate(sizes)}
    if not number:
        return []
    if keys:
        table = rows.sparkSession.createDataFrame([(*k, i) for k, i in number.items()], ", ".join([*own, "k_ int"]))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"key_.{k}").eqNullSafe(F.col(f"`{k}`"))
        data = slim.join(F.broadcast(table), same).select("k_", "v_")
    else:
        data = slim.select(F.lit(0).alias("k_"), "v_")
    n = np.array([m for _, m in sizes])
    # the two ranks about every share of every key, and the bits found so far
    at = np.multiply.outer(n - 1, np.array(shares))
    low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    ranks = np.repeat(np.concatenate([low, high], axis=1)[:, :, None], width, axis=2)
    found = np.zeros(ranks.shape, dtype=np.uint64)
    left = 64
    while left:
        bits = min(BITS, left)
        counts = _counts(data, found, left, bits, width)
        upto = counts.cumsum(axis=3)
        digit = (upto <= ranks[..., None]).sum(axis=3)
        below = np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[..., None], axis=3)[..., 0], 0)
        ranks = ranks - below
        left -= bits
        found |= digit.astype(np.uint64) << np.uint64(left)
    value, m = from_bits(found), len(shares)
    between = np.where((high == low)[..., None], value[:, :m], (high - at)[..., None] * value[:, :m] + (at - low)[..., None] * value[:, m:])
    return [(tuple(k) if keys else (), int(c), between[i]) for i, (k, c) in enumerate(sizes)]


def _counts(data: DataFrame, found: np.ndarray, left: int, bits: int, width: int) -> np.ndarray:
    """(keys, ranks, width, 2^bits): how many values share the found bits of each rank's value, by their next bits."""
    many = 1 << bits
    shift, mask = np.uint64(left - bits), np.uint64(many - 1)
    held = data.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        places = np.arange(width) * many
        for b in batches:
            x = ordered_bits(b.column("v_").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width))
            key = b.column("k_").to_numpy()
            for k in np.unique(key):
                u = x[key == k]
                own = total.setdefault(int(k), np.zeros((held.value.shape[1], width * many), dtype=np.int64))
                at = ((u >> shift) & mask).astype(np.int64) + places
                for side in range(len(own)):
                    inside = np.ones(u.shape, dtype=bool) if left == 64 else (u >> np.uint64(left)) == (held.value[k, side] >> np.uint64(left))
                    own[side] += np.bincount(at[inside], minlength=width * many)
        for k, v in total.items():
            yield pa.RecordBatch.from_pydict({"k_": pa.array([k], pa.int32()), "c_": pa.array([v.tobytes()], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("k_").to_pylist(), b.column("c_").to_pylist(), strict=True):
                one = np.frombuffer(c, dtype=np.int64)
                total[k] = total[k] + one if k in total else one
        for k, v in total.items():
            yield pa.RecordBatch.from_pydict({"k_": pa.array([k], pa.int32()), "c_": pa.array([v.tobytes()], pa.binary())})

    got = data.mapInArrow(run, "k_ int, c_ binary").repartition("k_").mapInArrow(add, "k_ int, c_ binary").toArrow()
    out = np.zeros((*found.shape, many), dtype=np.int64)
    for k, c in zip(got.column("k_").to_pylist(), got.column("c_").to_pylist(), strict=True):
        out[k] = np.frombuffer(c, dtype=np.int64).reshape(found.shape[1], width, many)
    return out

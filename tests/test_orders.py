"""Ranks over range partitions and medians of vectors, against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spectrel.operators import ranks, vectors


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_ranks(spark, keys, ranges):
    rng = np.random.default_rng(ranges)
    a = np.where(rng.random(900) < 0.4, 5, rng.integers(0, 40, 900))  # a tie of two fifths of all rows: longer than a range
    rows = [(i, "ab"[i % 7 == 0] if i % 11 else None, None if i % 50 == 0 else int(a[i]), float(rng.integers(0, 2))) for i in range(900)] + [(1, "a", 5, 0.0)] * 30
    df = spark.createDataFrame(rows, "id int, k string, a int, b double").repartition(6)
    got = ranks.global_rank(df, ["a", "b"], keys, ranges, number="number")
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("a", "b")
    want = sorted((str(r.id), str(r.k), r["rank"]) for r in df.withColumn("rank", F.rank().over(w)).collect())
    out = got.collect()
    assert sorted((str(r.id), str(r.k), r["rank"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.k if keys else None, []).append((r.number, r["rank"]))
    assert all(sorted(n for n, _ in v) == list(range(1, len(v) + 1)) and all(n >= k for n, k in v) for v in by.values())
    assert ranks.global_rank(df.limit(0), ["a"], keys, ranges).collect() == []


def test_bits_are_in_order():
    x = np.array([-np.inf, -1e300, -1.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf])
    u = vectors.ordered_bits(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5] and np.array_equal(vectors.from_bits(u), x)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1001])
def test_medians_of_vectors(spark, n):
    rng = np.random.default_rng(n)
    x = {k: np.round(rng.standard_normal((n + i, 5)) * np.array([1, 1e-9, 1e9, 0, 3]), i) for i, k in enumerate(["a", None])}
    x["a"][:, 4] = np.where(rng.random(n) < 0.5, 7.0, -7.0)
    rows = [(k, [float(v) for v in row]) for k, m in x.items() for row in m] + [("a", None)]
    got = {r.key: r for r in vectors.vector_medians(spark.createDataFrame(rows, "key string, x array<double>").repartition(3), ["key"], "x", 5).collect()}
    assert set(got) == {"a", None}
    for k, m in x.items():
        assert got[k].n == len(m) and np.array_equal(np.array(got[k].x), np.median(m, axis=0))
    assert vectors.vector_medians(spark.createDataFrame([], "key string, x array<double>"), ["key"], "x", 5).collect() == []

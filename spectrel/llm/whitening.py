"""Whitening of embeddings by a distributed singular value decomposition.

Entries become whole numbers, so that equal vectors are equal bit by bit and sums are exact. Each distinct vector counts once. The centred
distinct vectors are a distributed matrix whose singular values and right vectors MLlib finds; a singular value s belongs to the eigenvalue
s * s / n of the covariance, and a whitened value is the centred vector's product with the eigenvector, over the eigenvalue's root. The total
variance doesn't come from the singular values but from the sum of all vectors' squared deviations, in whole numbers.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm.common import Shelf, free_name, read

#: What 64 bits hold.
LARGEST = 1 << 63
#: Singular values below this share of the largest can't be told from rounding: they come from a matrix of squares.
LEAST = 1e-6
#: Vectors that are handled together in a task.
STEP = 4096


def whole_vectors(rows: DataFrame, vector: str, scale: int, name: str) -> DataFrame:
    """rows whose vector is neither null nor empty and has finite entries only, with floor(scale * entry) of its entries as an array of whole numbers."""
    ok = F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < float(LARGEST))), F.lit(False))
    return rows.where(ok).withColumn(name, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def projected(rows: DataFrame, vector: str, n: int, sums: list[int], axes: np.ndarray, roots: np.ndarray, keep: list[str], small: bool) -> DataFrame:
    """keep's columns, deviation (sum over the entries of (n * x - S)^2; long if all surely fit, else decimal, null over 38 digits) and w (array: the
    centred vector's product with each column of axes, over its root). small: whether they surely fit."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    schema = ", ".join([*fields, "deviation long" if small else "deviation decimal(38,0)", "w array<double>"])
    width, k = axes.shape

    def run(batches):
        total = np.array(sums, dtype=np.int64 if small else object)
        mean = np.array([float(Fraction(s, n)) for s in sums])
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                x = b.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                d = (x if small else x.astype(object)) * n - total
                squares = (d * d).sum(axis=1)
                exact = pa.array(squares) if small else pa.array([Decimal(v) if v < 10**38 else None for v in map(int, squares)], pa.decimal128(38, 0))
                w = ((x - mean) @ axes) / roots
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.reshape(-1))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], exact, lists], names=[*keep, "deviation", "w"])

    return rows.select(*dict.fromkeys([*keep, vector])).mapInArrow(run, schema)


def whiten(rows: DataFrame, components: int = 4, scale: int = 256, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """A row for each row of rows and component: rows' columns (or keep), component (from 1, by falling eigenvalue), n, deviation, whitened, explained and
    identity_error.

    x is floor(scale * entry) of a row's entries. n: distinct vectors x, over which all means and covariances are taken, with divisor n; deviation: the exact sum over the entries of
    (n * x - S)^2, S being the sums over the distinct vectors; whitened: x - S / n on the component, over the root of its eigenvalue; explained: the eigenvalue's share of the total variance;
    identity_error: the largest entry of the covariance of whitened values, less the identity, over the distinct vectors (one value).

    Rows whose vector is null, empty, or holds null or non-finite entries (or entries that 64 bits don't hold, times scale) are left out. Where
    lengths differ, the length that most rows have (of several the largest) is the table's, and other rows are left out. Components without variance can't be whitened and
    aren't given: a table with one distinct vector gives an empty table, as an empty one does. Repeated rows have rows of their own and equal values. A deviation that
    64 bits don't hold is null. Columns of rows with the names of new ones are replaced. The fit holds a square of the vectors' length on the driver, up to some thousand.
    """
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    spark, shelf = rows.sparkSession, Shelf(rows.sparkSession, "whitening")
    kept = [c for c in (rows.columns if keep is None else keep) if c.lower() not in new]
    (x,) = free_name(rows, "x")
    inner = {c: f"c{i}" for i, c in enumerate(kept)}
    table = whole_vectors(rows, vector, scale, x).select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()], F.col(x).alias("x"))
    given = [F.col(i).alias(c) for c, i in inner.items()]

    def nothing() -> DataFrame:
        return table.where(F.lit(False)).select(*given, F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in new[1:3]], *[F.lit(0.0).alias(c) for c in new[3:]])

    widths = table.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return nothing()
    width = widths["width"]
    table = table.where(F.size("x") == width)
    fit = shelf.put(table.select("x").distinct())
    # exact: sums of 64-bit numbers in 38 digits, a row an entry
    entry = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    of = {r["i"]: r for r in entry.collect()}
    n, sums = of[0]["n"], [int(of[i]["s"]) for i in range(width)]
    far = [max(abs(n * of[i]["lo"] - sums[i]), abs(n * of[i]["hi"] - sums[i])) for i in range(width)]
    small = max(sum(v * v for v in far), max(map(abs, sums)), n * max(abs(v) for r in of.values() for v in (r["lo"], r["hi"]))) < LARGEST
    if not any(far):
        return nothing()
    # the centred distinct vectors, in the JVM
    mean = F.array(*[F.lit(float(Fraction(s, n))) for s in sums])
    centred = fit.select(array_to_vector(F.zip_with("x", mean, lambda a, m: a - m)).alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, width).computeSVD(width, computeU=False, rCond=LEAST)
    values = np.array(svd.s.toArray()) ** 2 / n
    axes = svd.V.toArray()[:, : min(components, len(values))]
    values = values[: axes.shape[1]]
    roots = np.sqrt(values)
    own = shelf.put(projected(fit, "x", n, sums, axes, roots, [], small))
    k = len(values)
    totals = own.agg(F.sum(F.col("deviation").cast("decimal(38,0)")).alias("d"), F.count("deviation").alias("m"), *[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    if totals["d"] is None or totals["m"] < n:
        raise ValueError("the total variance has more than 38 digits")
    trace = float(Fraction(int(totals["d"]), n**3))
    dev = [F.col("w")[i] - totals[f"m{i}"] for i in range(k)]
    cov = own.agg(*[F.avg(dev[i] * dev[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    out = projected(table, "x", n, sums, axes, roots, list(inner.values()), small)
    shelf.keep()
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    out = out.select("*", F.posexplode("w").alias("k", "whitened"))
    return out.select(
        *given, (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        explained[F.col("k")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() of all embeddings, four components; edge cases as defined there."""
    return whiten(read(spark, sf_dir, "embeddings"), keep=["vec_id"])

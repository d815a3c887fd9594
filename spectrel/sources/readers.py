"""Readers of recordings and manifests, and checks of them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.functions.columns import is_finite
from spectrel.operators.robust import assert_none

#: Fields that every file of a manifest has.
FILE_FIELDS = ("code", "activity", "model", "mode", "part", "segment", "group_id", "partition", "relative_path", "sample_rate_hz", "sha256")
FILE_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c == "sample_rate_hz" else T.IntegerType() if c in ("segment", "max_segment") else T.LongType() if c == "size_bytes" else T.StringType()) for c in (*FILE_FIELDS, "size_bytes", "filename", "max_segment")])
MANIFEST_SCHEMA = T.StructType([T.StructField("status", T.StringType()), T.StructField("files", T.ArrayType(FILE_SCHEMA))])
#: Keys of packages that would give the label away.
LABEL_KEYS = ("label", "etiqueta", "activity", "actividad", "model", "modelo", "mode", "modo", "code", "codigo", "expected")


def as_number(token: Column) -> Column:
    """The number that a text stands for (also nan and inf), null if it is none; hexadecimal numbers and suffixes of types are none."""
    return F.when(~token.rlike(r"^[-+]?0[xX]|[0-9.][dDfF]$"), token.try_cast("double"))


def numbers(text: Column) -> Column:
    """The numbers of a text, separated by commas, semicolons or white space; a first row that isn't the only one is passed over as a header if it holds
    something that is no number. An error where another value is no number. For texts that fit in a row; longtext reads longer ones."""
    tokens = lambda t: F.filter(F.split(F.trim(t), r"[,;\s]+"), lambda v: v != "")
    first = F.substring_index(text, "\n", 1)
    header = F.contains(text, F.lit("\n")) & F.exists(tokens(first), lambda v: as_number(v).isNull())
    body = F.when(header, F.substring(text, F.length(first) + 2, F.length(text))).otherwise(text)
    return F.transform(tokens(body), lambda v: F.coalesce(as_number(v), F.raise_error(F.concat(F.lit("no number: "), v)).cast("double")))


def strict_integers(text: Column) -> Column:
    """The integers of a one-line text whose values all are written with six zero decimals; null if any isn't."""
    parts = F.split(F.regexp_replace(F.trim(text), r",$", ""), ",")
    ok = F.forall(parts, lambda v: v.rlike(r"^-?\d{1,6}\.000000$"))
    return F.when(ok, F.transform(parts, lambda v: v.try_cast("double").cast("int")))


def read_text_signals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, x): of text files; the strict form where it holds, else the lenient one."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    strict = strict_integers(F.col("value"))
    return files.select("path", F.coalesce(F.transform(strict, lambda v: v.cast("double")), numbers(F.col("value"))).alias("x"))


def complex_pairs(rows: DataFrame, columns: tuple[str, str] = ("c0", "c1")) -> DataFrame:
    """rows with z: a two-column sample as one complex number."""
    return rows.withColumn("z", F.struct(F.col(columns[0]).alias("re"), F.col(columns[1]).alias("im")))


#: NumPy's types for the element types of level-5 MAT files, and the classes of numeric arrays.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_NUMERIC = 14, 15, range(6, 16)


def _mat_elements(data: bytes, order: str):
    """(type, bytes) of the elements one after the other; short ones carry their bytes in the tag, and all but compressed ones are padded to 8."""
    at = 0
    while at + 8 <= len(data):
        kind, size = (int(v) for v in np.frombuffer(data, dtype=order + "u4", count=2, offset=at))
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == MAT_COMPRESSED else -size % 8)


def mat_arrays(content: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a level-5 MAT file by name, but for names with two underscores in front."""
    import zlib

    order = "<" if content[126:128] == b"IM" else ">"
    out = {}
    for kind, data in _mat_elements(content[128:], order):
        if kind == MAT_COMPRESSED:
            kind, data = next(_mat_elements(zlib.decompress(data), order))
        if kind != MAT_MATRIX:
            continue
        parts = list(_mat_elements(data, order))
        flags = np.frombuffer(parts[0][1], dtype=order + "u4")[0]
        if int(flags) & 0xFF not in MAT_NUMERIC or len(parts) < 4:
            continue
        shape, name = np.frombuffer(parts[1][1], dtype=order + "i4"), parts[2][1].decode("latin-1")
        values = [np.frombuffer(v, dtype=order + MAT_TYPES[k]) for k, v in parts[3:5] if k in MAT_TYPES]
        a = values[0] + 1j * values[1] if int(flags) >> 11 & 1 and len(values) > 1 else values[0]
        if not name.startswith("__"):
            out[name] = a.reshape(tuple(shape), order="F")
    return out


def decode_arrays(files: DataFrame, variable: str | None = None) -> DataFrame:
    """(path, name, shape, x, im) of NumPy files (.npy, .npz) and level-5 MAT files read as binaryFile: the named array of a package, else every array that is
    numeric. Rows in order, flattened; complex arrays have im, too."""
    schema = "path string, name string, shape array<long>, x array<double>, im array<double>"

    def run(batches):
        import io

        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if content[:10] == b"MATLAB 5.0":
                    arrays = mat_arrays(content)
                else:
                    got = np.load(io.BytesIO(content), allow_pickle=False)
                    arrays = {k: got[k] for k in got.files} if hasattr(got, "files") else {"": got}
                for name, a in arrays.items():
                    if (variable is None or name == variable) and a.dtype.kind in "iufcb":
                        z = a.reshape(-1)
                        out.append((path, name, list(a.shape), z.real.astype(float).tolist(), z.imag.astype(float).tolist() if a.dtype.kind == "c" else None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "name", "shape", "x", "im"])

    return files.select("path", "content").mapInArrow(run, schema)


def iq_signals(arrays: DataFrame) -> DataFrame:
    """arrays (shape, x, im) where two-dimensional real ones with a side of two are one complex signal: x and im are its real and imaginary parts."""
    two = (F.size("shape") == 2) & F.col("im").isNull()
    columns, rows = two & (F.col("shape")[1] == 2), two & (F.col("shape")[0] == 2)
    half = (F.size("x") / 2).cast("int")
    even = lambda first: F.filter("x", lambda v, i: i % 2 == first)
    real = F.when(columns, even(0)).when(rows, F.slice("x", F.lit(1), half)).otherwise(F.col("x"))
    imaginary = F.when(columns, even(1)).when(rows, F.slice("x", half + 1, half)).otherwise(F.col("im"))
    return arrays.withColumns({"x": real, "im": imaginary})


def read_arrays(spark: SparkSession, paths: str | list[str], variable: str | None = None) -> DataFrame:
    return decode_arrays(spark.read.format("binaryFile").load(paths), variable)


def input_parts(arrays: DataFrame, fs: float | None = None, least: int = 16) -> DataFrame:
    """(path, part, preprocessed, window_size, fs_hz, x) from decoded packages: windows or signals of parts L and H, else the largest array as
    the only part. Keys like labels are passed over; an error for short or non-finite signals, a missing part of a pair, or no positive rate."""
    rows = arrays.where(~F.lower("name").isin(*LABEL_KEYS))
    part = F.upper(F.nullif(F.regexp_extract(F.lower("name"), r"^(?:ventanas|senal|windows|signal)_([lh])$", 1), F.lit("")))
    rows = rows.withColumn("part", part).withColumn("windowed", F.lower("name").rlike("^(ventanas|windows)_"))
    facts = rows.groupBy("path").agg(F.max(F.when(F.col("name").isin("fs_hz", "fs"), F.col("x")[0])).alias("own_fs"), F.max(F.when(F.col("name") == "preprocessed", F.col("x")[0])).alias("pre"), F.count("part").alias("parts"), F.max("windowed").alias("any_windows"), F.max_by("name", F.when(F.col("part").isNull() & ~F.col("name").isin("fs_hz", "fs", "preprocessed", "window_size"), F.size("x"))).alias("largest"))
    both = rows.join(facts, "path").where(F.when(F.col("parts") > 0, F.col("part").isNotNull() & (F.col("windowed") == F.col("any_windows"))).otherwise(F.col("name") == F.col("largest")))
    rate = F.coalesce(F.lit(fs).cast("double"), F.col("own_fs"))
    fail = lambda bad, what, v: F.when(bad, F.raise_error(F.lit(what)).cast("array<double>")).otherwise(v)
    x = fail(F.coalesce(rate, F.lit(0.0)) <= 0, "the sampling rate is missing or not positive", F.col("x"))
    x = fail(F.size("x") < least, "the signal is too short", x)
    x = fail(F.exists("x", lambda v: ~is_finite(v)), "a sample isn't finite", x)
    x = fail(F.col("windowed") & (F.coalesce("pre", F.lit(0.0)) != 1), "windows aren't marked as preprocessed", x)
    x = fail((F.col("any_windows")) & (F.col("parts") < 2), "a package of windows has both parts", x)
    return both.select("path", F.coalesce("part", F.lit("ONLY")).alias("part"), F.col("windowed").alias("preprocessed"), F.when(F.col("windowed"), F.col("shape")[1]).alias("window_size"), rate.alias("fs_hz"), x.alias("x"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of a dataset manifest; an error if it isn't ready, is empty, or a file lacks a field."""
    top = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    assert_none(top.where("status IS NULL OR status <> 'local_subset_ready' OR files IS NULL OR size(files) = 0").select("status"), "the manifest isn't ready")
    files = top.select(F.inline("files"))
    lacking = F.lit(False)
    for c in FILE_FIELDS:
        lacking = lacking | F.col(c).isNull()
    assert_none(files.where(lacking).select("relative_path"), "files of the manifest lack fields")
    return files


def partition_files(files: DataFrame, partitions: Iterable[str]) -> DataFrame:
    return files.where(F.col("partition").isin(*partitions))


def missing_files(files: DataFrame, listing: DataFrame, path: str = "relative_path", size: str = "size_bytes") -> DataFrame:
    """The files that the listing (path, size_bytes) lacks or has with another size."""
    there = listing.select(F.col("path").alias("there_"), F.col("size_bytes").alias("size_"))
    return files.join(there, F.col(path) == F.col("there_"), "left").where(F.col("there_").isNull() | (F.col(size) != F.col("size_"))).drop("there_", "size_")


def pairs(files: DataFrame, key: str = "segment") -> DataFrame:
    """(key, path_l, path_h): parts of one key; path_h is null where H is missing."""
    low = files.where("part = 'L'").select(key, F.col("path").alias("path_l"))
    high = files.where("part = 'H'").select(key, F.col("path").alias("path_h"))
    return low.join(high, key, "left")


def read_features(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """A table of features or results from CSV with a header, by its schema; nothing is inferred."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def canonical_hash(text: Column) -> Column:
    """SHA-256 of a text with every line end as a line feed."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n").cast("binary"), 256)

"""Shared helpers of the corpus operators: word splitting, hashing, shared-folder tables and Arrow row maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and every ASCII byte that is no letter or digit becomes a space; bytes of 0x80 and above stay.
LOWER_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The letters and digits rule as a pattern for SQL engines, applied to text whose A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts handled together in one step of a Python worker hold about so many bytes; a longer text stands alone.
STEP_BYTES = 4 << 20


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; none for None."""
    return text.translate(LOWER_ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space; none for None."""
    return text.translate(LOWER).split() if text else []


class WordHashes(dict):
    """XXH64 of words, kept up to a number of entries; long words aren't kept."""

    def __init__(self, seed: int = 42, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 200:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive word hashes, as many as there are places."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def free_name(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset and all runs in this process, a folder of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = at.get() if at.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="spectrel-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


class Shelf:
    """Tables in the shared folder that cut lineage; drop() deletes one that nothing reads any more, keep() all but the named. What a
    result still reads stays until its user deletes the folder."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: dict[str, DataFrame] = {}

    def put(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """df, written as Parquet and read again."""
        path = f"{self.top}/{self.n}"
        self.n += 1
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        self.tables[path] = out
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._shelf_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables.pop(df._shelf_path, None)

    def keep(self, *needed: DataFrame) -> None:
        for df in list(self.tables.values()):
            if not any(df is n for n in needed):
                self.drop(df)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.cast(pa.binary())


def steps(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def per_text(df: DataFrame, text: str, out: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list[bytes | None]], list]], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) and new columns made from whole texts in Arrow batches, without a shuffle.

    make() is called once for each task and gives a function from the texts of a step (UTF-8 bytes, None for null) to one list
    or numpy array for each new column. Names of `out` that df has already replace df's.
    """
    names = [n for n, _ in out]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    need = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*[f for f in need.schema.fields if f.name != "__text"], *[T.StructField(n, t) for n, t in out]])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for _, t in out]

    def run(batches):
        do = None
        for whole in batches:
            for b in steps(whole, "__text"):
                do = do or make()
                cols = do(text_bytes(b.column("__text")).to_pylist())
                arrays = [pa.array(c, type=k, from_pandas=False) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + arrays, names=kept + names)

    return need.mapInArrow(run, schema)


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER_AZ, LOWER_AZ)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; the environment variable PUBLIC_TOKENIZERS names another folder."""
    if top := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(top, name)
    import public_tokenizers

    return public_tokenizers.path(name)

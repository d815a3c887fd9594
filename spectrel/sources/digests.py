"""SHA-256 of files of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to so many bytes are hashed as a value of a row; larger ones are read in pieces.
SMALL, PIECE = 256 << 20, 8 << 20


def file_digests(spark: SparkSession, path: str | list[str], small: int = SMALL) -> DataFrame:
    """(path, size_bytes, sha256) of every file under a path. Small files come by Spark's reader, from any store; a larger one is read in pieces by one task, from
    stores that Arrow reaches too, and never held."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    one = files.where(F.col("length") <= small).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > small).select("path", "length").repartition("path")

    def run(batches):
        import hashlib

        from spectrel.sources.archives import located

        for b in batches:
            for p, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                fs, at = located(p)
                digest, size = hashlib.sha256(), 0
                with fs.open_input_stream(at) as f:
                    while piece := f.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                if size != length:
                    raise OSError(f"{p} has changed while it was read")
                yield pa.RecordBatch.from_pydict({"path": [p], "size_bytes": [size], "sha256": [digest.hexdigest()]})

    return one.unionByName(large.mapInArrow(run, "path string, size_bytes long, sha256 string"))

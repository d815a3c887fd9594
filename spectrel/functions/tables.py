"""Tables that cut lineage: written to the folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset and all runs in this process, a folder of our own."""
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spectrel-")
    sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df, computed once. What reads it afterwards survives the loss of executors; the files go with the session's checkpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df, written as Parquet to the shared folder and read from there: columns that aren't asked for aren't read again."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

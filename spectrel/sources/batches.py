"""Tables that are built in batches, any of which may break off or be done twice.

A batch is written to a folder of its own attempt. Only when that is whole, a record of it (batch, attempt, rows, when) is put beside the table,
as a file that appears at once by its renaming. What is read are the attempts with a record, one for each batch: the first that was recorded.
An attempt that broke off has no record and is never read; of a batch that two runs did, one counts. Rows are counted again when they are read.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.operators.robust import assert_none

#: What is recorded of an attempt: how many rows each of its tables has.
RECORD = "batch int, attempt string, at long, rows map<string,long>"


@dataclass(frozen=True)
class BatchTable:
    """Tables at a path, by batches. batches: how many there can be; that many records come to the driver at most, however many files a batch has."""

    spark: SparkSession
    path: str
    batches: int

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def folder(self, table: str, batch: int, attempt: str) -> str:
        return f"{self.path}/{table}/batch={batch}/attempt={attempt}"

    def write(self, batch: int, tables: dict[str, DataFrame]) -> str:
        """Writes an attempt's tables and returns its name. It isn't read before it is recorded."""
        if not 0 <= batch < self.batches:
            raise ValueError(f"batches are numbered from 0 to {self.batches - 1}")
        attempt = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(self.folder(name, batch, attempt))
        return attempt

    def attempted(self, table: str, batch: int, attempt: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(table, batch, attempt))

    def record(self, batch: int, attempt: str, tables: list[str]) -> None:
        rows = {t: self.attempted(t, batch, attempt).count() for t in tables}
        text = json.dumps({"batch": batch, "attempt": attempt, "at": time.time_ns(), "rows": rows}, sort_keys=True)
        fs, at = self._fs(f"{self.path}/records/{batch}-{attempt}.json")
        _, draft = self._fs(f"{self.path}/records/.{batch}-{attempt}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not fs.rename(draft, at):
            raise OSError(f"the record of batch {batch} could not be put at {at}")

    def records(self) -> dict[int, dict]:
        """Of every recorded batch the first record; one for each batch, so at most as many as there are batches."""
        fs, at = self._fs(f"{self.path}/records")
        if not fs.exists(at) or not any(f.getPath().getName().endswith(".json") for f in fs.listStatus(at)):
            return {}
        all_ = self.spark.read.schema(RECORD).json(f"{self.path}/records/*.json")
        first = all_.groupBy("batch").agg(F.min(F.struct("at", "attempt", F.to_json("rows").alias("rows"))).alias("r")).select("batch", "r.attempt", "r.rows")
        return {r["batch"]: {"attempt": r["attempt"], "rows": json.loads(r["rows"])} for r in first.limit(self.batches + 1).collect()}

    def missing(self) -> list[int]:
        done = self.records()
        return [b for b in range(self.batches) if b not in done]

    def read(self, table: str) -> DataFrame:
        """The rows of the recorded attempts, with their batch. An error if none is recorded, or if a batch hasn't the rows that its record says."""
        done = self.records()
        if not done:
            raise ValueError(f"no batch of {self.path} is recorded")
        paths = [self.folder(table, b, r["attempt"]) for b, r in sorted(done.items())]
        df = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths)
        said = self.spark.createDataFrame([(b, int(r["rows"][table])) for b, r in sorted(done.items())], "batch int, said long")
        off = said.join(df.groupBy("batch").agg(F.count("*").alias("found")), "batch", "left").where(F.coalesce("found", F.lit(0)) != F.col("said"))
        assert_none(off.select("batch"), f"batches of {table} that haven't the rows that were recorded")
        return df.drop("attempt")

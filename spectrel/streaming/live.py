"""Framing, scores and decisions of recordings while their samples arrive.

A part's state is a ring of the samples that its next frame still needs, and its scores so far; a group's decision is given anew whenever one of its
parts has another `step` windows. Samples may come out of order and twice within the watermark's delay. A sample that is later is dropped; the frames that
it would be in are passed over once the samples after it are older than the watermark, so a ring doesn't grow. When a group gets no samples for some time, a timer
says so and its state goes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spectrel.operators.decision import decide_binary

#: A part's state: the next frame, its held samples with their times, and its scores.
PART = "part string, idx long, n array<long>, x array<double>, at array<long>, scores array<double>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Ring:
    """The samples that frames of `size` every `hop` samples still need; idx is the next frame's number."""

    def __init__(self, size: int, hop: int, idx: int = 0, n: Sequence[int] = (), x: Sequence[float] = (), at: Sequence[int] = ()):
        self.size, self.hop, self.idx = size, hop, idx
        self.n, self.x, self.at = np.array(n, dtype=np.int64), np.array(x, dtype=np.float64), np.array(at, dtype=np.int64)

    def push(self, n: np.ndarray, x: np.ndarray, at: np.ndarray, settled: int) -> Iterator[tuple[int, np.ndarray]]:
        """Adds samples (the first one of a place counts) and gives (number, samples) of every frame that is whole now. settled: the time before which nothing can come any more."""
        n, first = np.unique(np.r_[self.n, n], return_index=True)
        self.n, self.x, self.at = n, np.r_[self.x, x][first], np.r_[self.at, at][first]
        while True:
            self._forget()
            start = self.idx * self.hop
            held = int(np.searchsorted(self.n, start + self.size))
            if held == self.size:
                yield self.idx, self.x[:held].copy()
                self.idx += 1
                continue
            # a frame that lacks a sample is passed over if a later sample is settled
            if len(self.n) and held < self.size:
                lacking = np.setdiff1d(np.arange(start, start + self.size), self.n[:held])
                if (self.at[self.n > lacking[-1]] < settled).any():
                    self.idx += 1
                    continue
            return

    def _forget(self) -> None:
        drop = int(np.searchsorted(self.n, self.idx * self.hop))
        self.n, self.x, self.at = self.n[drop:], self.x[drop:], self.at[drop:]


def frame_rms(windows: np.ndarray) -> np.ndarray:
    return np.sqrt((windows * windows).mean(1))


class LiveGroup(StatefulProcessor):
    """Of a group's samples (part, n, x, ts) the frames' scores and, at every step, the group's score over the prefix."""

    def __init__(self, size: int, hop: int, score: Callable[[np.ndarray], np.ndarray], step: int, most: int, idle_ms: int):
        self.size, self.hop, self.score, self.step, self.most, self.idle = size, hop, score, step, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part string", PART)
        self.last = handle.getValueState("last", "stop long, score double, parts_used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs()
        got = pd.concat(list(rows))
        times = (got["ts"].astype("int64") // 1_000_000 if got["ts"].dtype == "datetime64[ns]" else got["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).to_numpy()
        reached: set[int] = set()
        for part in sorted(got["part"].unique()):
            held = self.parts.getValue((part,)) if self.parts.containsKey((part,)) else (part, 0, [], [], [], [])
            ring, scores = Ring(self.size, self.hop, int(held[1]), held[2], held[3], held[4]), list(held[5])
            own = (got["part"] == part).to_numpy()
            before = len(scores)
            frames = [w for _, w in ring.push(got["n"].to_numpy()[own].astype(np.int64), got["x"].to_numpy()[own].astype(np.float64), times[own], settled)]
            if frames and before < self.most:
                scores += [float(s) for s in self.score(np.array(frames[: self.most - before]))]
            self.parts.updateValue((part,), (part, ring.idx, ring.n.tolist(), ring.x.tolist(), ring.at.tolist(), scores))
            reached |= set(range((before // self.step + 1) * self.step, len(scores) + 1, self.step))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(int(times.max()), settled) + self.idle)
        if reached:
            all_ = [list(v[5]) for _, v in self.parts.iterator()]
            out = []
            for stop in sorted(reached):
                medians = [float(np.median(s[:stop])) for s in all_ if len(s) >= stop]
                out.append((key[0], stop, sum(medians) / len(medians), len(medians), False))
            self.last.update((out[-1][1], out[-1][2], out[-1][3]))
            yield pd.DataFrame(out, columns=["group_id", "stop", "score", "parts_used", "stopped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stop, score, used = self.last.get() if self.last.exists() else (0, None, 0)
        self.parts.clear()
        self.last.clear()
        yield pd.DataFrame({"group_id": [key[0]], "stop": [int(stop)], "score": [score], "parts_used": [int(used)], "stopped": [True]})

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """The store of state that these operators need, while a query starts and runs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def live_scores(samples: DataFrame, size: int, hop: int, score: Callable[[np.ndarray], np.ndarray], step: int = 10, most: int = 200, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """A stream of (group_id, stop, score, parts_used, stopped) from a stream of samples (group_id, part, n, x, ts): the group's score over the first `stop` windows
    of its parts, given when a part gets that far; of a group's rows for one stop the last one counts. stopped: no sample came for idle_ms after the last one; the row repeats what
    was reached. score: from a matrix of windows a score each. Samples are conditioned with parameters fixed before, as a stream can't know a whole record's."""
    # the process that plans such a query on the driver is sent no package, so that this module's code goes with the processor
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("group_id").transformWithStateInPandas(LiveGroup(size, hop, score, step, most, idle_ms), "group_id string, stop long, score double, parts_used long, stopped boolean", "Update", "EventTime")


def live_decisions(scores: DataFrame, threshold: float, rejection: float) -> DataFrame:
    """live_scores() with threshold, prediction, margin, rejected and visible."""
    return decide_binary(scores, threshold, rejection).withColumn("threshold", F.lit(threshold))


def last_rows(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Of what a stream gave (rows with their batch) the last row of every group and stop, with changed: whether the decision differs from that at the stop before. As
    replay.evolution() gives it."""
    given = [c for c in rows.columns if c != batch]
    last = rows.where("not stopped").groupBy("group_id", "stop").agg(F.max_by(F.struct(*given), batch).alias("r")).select("r.*")
    before = F.lag("visible").over(Window.partitionBy("group_id").orderBy("stop"))  # a row a step of a group
    return last.withColumn("changed", F.coalesce(before != F.col("visible"), F.lit(False))).select("group_id", "stop", "score", "parts_used", "threshold", "visible", "changed")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, and gives its rows with their batch. A batch that is done again replaces its own."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    with keyed_state(stream.sparkSession):
        q = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)

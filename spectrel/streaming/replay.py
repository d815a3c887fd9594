"""Progressive evaluation: growing prefixes of each part's windows, in batch form and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spectrel.operators.decision import decide_binary


def prefixes(windows: DataFrame, step: int = 10, most: int = 200, index: str = "idx") -> DataFrame:
    """windows with stop: one copy for each prefix of step, 2 * step, ... windows that a window belongs to, as long as its part has that many.

    A window at i is in the prefixes that stop after i; the part's length comes from an aggregate."""
    length = windows.groupBy("group_id", "part").agg(F.least(F.count("*"), F.lit(most)).alias("length_"))
    first = (F.floor(F.col(index) / F.lit(step)) + 1) * step
    stops = F.when(first <= F.col("length_"), F.sequence(first, F.greatest(first, F.floor(F.col("length_") / F.lit(step)) * step), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return windows.where(F.col(index) < most).join(length, ["group_id", "part"]).select(*windows.columns, F.explode(stops).alias("stop"))


def progressive_scores(scored: DataFrame, score: str = "score", step: int = 10, most: int = 200) -> DataFrame:
    """(group_id, stop, score, parts_used): the group's score over each prefix."""
    parts = prefixes(scored, step, most).groupBy("group_id", "part", "stop").agg(F.median(score).alias(score))
    return parts.groupBy("group_id", "stop").agg(F.avg(score).alias(score), F.count("*").alias("parts_used"))


def evolution(scored: DataFrame, threshold: float, rejection: float, score: str = "score", step: int = 10, most: int = 200) -> DataFrame:
    """(group_id, stop, score, parts_used, threshold, visible, changed): the decision over each prefix, and whether it differs from the one before."""
    out = decide_binary(progressive_scores(scored, score, step, most), threshold, rejection, score).withColumn("threshold", F.lit(threshold))
    before = F.lag("visible").over(Window.partitionBy("group_id").orderBy("stop"))  # a row a step of a group
    return out.withColumn("changed", F.coalesce(before != F.col("visible"), F.lit(False))).select("group_id", "stop", score, "parts_used", "threshold", "visible", "changed")


def running_medians(scored: DataFrame, score: str = "score", most: int = 200) -> DataFrame:
    """A stream of (group_id, part, seen, median) from a stream of scored windows: the state of a part is the list of its scores so far, `most` at
    the most. Scores come from windows normalised with parameters fixed before, as a stream can't know a whole record's."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held += f.sort_values("idx")[score].tolist()
        held = held[:most]
        state.update((held,))
        yield pd.DataFrame({"group_id": [key[0]], "part": [key[1]], "seen": [len(held)], "median": [float(pd.Series(held).median())]})

    return scored.groupBy("group_id", "part").applyInPandasWithState(update, "group_id string, part string, seen long, median double", "scores array<double>", "update", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """The started query that gives every micro-batch to `act`."""
    writer = stream.writeStream.foreachBatch(act).outputMode("update")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 day", late: str | None = "2 days", keys: Sequence[str] = ("event_type",)) -> DataFrame:
    """(start, keys, events, value_sum) by tumbling windows of event time; in a stream, events later than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value_sum"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "events", "value_sum")

"""Framing of records into windows. Starts are computed first and joined with samples by arithmetic, so no frame is made to be thrown away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.operators.conditioning import RECORD, by_record


def frame_count(length: Column, size: int, hop: int) -> Column:
    return F.when(length >= size, F.floor((length - size) / F.lit(hop)) + 1).otherwise(F.lit(0)).cast("long")


def frame_table(samples: DataFrame, size: int, hop: int | None = None, drop_last: bool = True, keys: Sequence[str] = RECORD, keep: Sequence[str] = ("label",)) -> DataFrame:
    """One row a frame: keys, keep, idx, start, stop.

    Starts are 0, hop, ... as far as a frame fits. With drop_last false, a last frame ends at the record's end if none does, and a shorter record
    has one frame that stops at its end (its missing samples count as zero)."""
    hop = hop or size
    if size <= 0 or hop <= 0:
        raise ValueError("size and hop are positive")
    length = samples.groupBy(*keys).agg(F.count("*").alias("length"), *[F.min(k).alias(k) for k in keep])
    n = frame_count(F.col("length"), size, hop)
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: i * hop)).otherwise(F.array().cast("array<bigint>"))
    if not drop_last:
        tail = F.greatest(F.col("length") - size, F.lit(0)).cast("long")
        ends = F.when(n > 0, (n - 1) * hop + size).otherwise(F.lit(0))
        starts = F.when((ends < F.col("length")), F.concat(starts, F.array(tail))).otherwise(starts)
    out = length.select(*keys, *keep, "length", F.posexplode(starts).alias("idx", "start"))
    return out.select(*keys, *keep, F.col("idx").cast("long").alias("idx"), "start", F.least(F.col("start") + size, F.col("length")).alias("stop"))


def framed(samples: DataFrame, size: int, hop: int | None = None, keys: Sequence[str] = RECORD) -> DataFrame:
    """samples dealt into full frames: one row for each frame and sample, idx and the place m in the frame. Every sample is in at most
    ceil(size / hop) frames, found by arithmetic; the record's length comes from an aggregate."""
    hop = hop or size
    length = samples.groupBy(*keys).agg(F.count("*").alias("length_"))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / F.lit(hop)))
    last = F.least(F.floor(F.col("n") / F.lit(hop)), frame_count(F.col("length_"), size, hop) - 1)
    j = F.when(first <= last, F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = samples.join(by_record(length), list(keys)).select("*", F.explode(j).alias("idx"))
    return out.withColumn("m", F.col("n") - F.col("idx") * hop).drop("length_")


def frame_arrays(recs: DataFrame, size: int, hop: int | None = None) -> DataFrame:
    """From one row a record (x as array): one row a window with win, idx, start, stop. Narrow."""
    hop = hop or size
    n = frame_count(F.size("x"), size, hop)
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    rest = [c for c in recs.columns if c != "x"]
    out = recs.select(*rest, "x", F.explode(starts).alias("idx"))
    return out.select(*rest, "idx", (F.col("idx") * hop).alias("start"), (F.col("idx") * hop + size).alias("stop"), F.slice("x", (F.col("idx") * hop + 1).cast("int"), F.lit(size)).alias("win"))


def deterministic_starts(frames: DataFrame, n_windows: int, keys: Sequence[str] = RECORD) -> DataFrame:
    """Of each record's frames (idx from 0 without gaps) n_windows evenly spread ones, all if there are no more."""
    count = frames.groupBy(*keys).agg(F.count("*").alias("c"))
    step = F.col("c") - 1
    j = F.sequence(F.lit(0), F.lit(n_windows - 1))
    even = F.transform(j, lambda i: F.when(i == n_windows - 1, step).otherwise(F.floor(i * (step / F.lit(max(1, n_windows - 1)))))) if n_windows > 1 else F.array(F.lit(0).cast("long"))
    chosen = count.select(*keys, F.explode(F.when(F.col("c") > n_windows, even).otherwise(F.sequence(F.lit(0).cast("long"), step))).alias("idx"))
    return frames.join(chosen, [*keys, "idx"])


def representative(samples: DataFrame, size: int, candidates: int = 20, keys: Sequence[str] = RECORD, digits: int = 6) -> DataFrame:
    """For each record the first of its first windows, which don't overlap, whose RMS is nearest to their median: idx and rms. Distances that agree
    in `digits` decimals are equal."""
    per = framed(samples.where(F.col("n") < size * candidates), size, size, keys).groupBy(*keys, "idx").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    middle = per.groupBy(*keys).agg(F.median("rms").alias("mid"))
    off = F.round(F.abs(F.col("rms") - F.col("mid")), digits)
    best = F.min(F.struct(off.alias("off"), "idx", "rms"))
    return per.join(middle, list(keys)).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.idx", "b.rms")


def sampled_windows(samples: DataFrame, size: int, hop: int, n_windows: int, keys: Sequence[str] = RECORD, keep: Sequence[str] = ("label",)) -> DataFrame:
    """One row a window of `size` samples: keys, keep, number, idx, start, stop, win; of every record's frames n_windows evenly spread ones, all if there
    are no more. Which frames are chosen follows from the record's length, so a sample goes to chosen frames only."""
    length = samples.groupBy(*keys).agg(F.count("*").alias("length_"), *[F.min(k).alias(k) for k in keep])
    length = length.withColumn("c_", frame_count(F.col("length_"), size, hop)).where("c_ > 0")
    c, last = F.col("c_"), n_windows - 1
    even = F.array(c - 1) if n_windows > 1 else F.array(F.lit(0).cast("long"))
    if n_windows > 1:
        even = F.concat(F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda j: F.floor(j * ((c - 1) / F.lit(last)))), even)
    chosen = F.when(c > n_windows, even).otherwise(F.sequence(F.lit(0).cast("long"), c - 1))
    length = length.select(*keys, *keep, "c_", chosen.alias("chosen_"))  # a row a record

    first = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / F.lit(hop)))
    end = F.least(F.floor(F.col("n") / F.lit(hop)), c - 1)
    frames = F.when(first <= end, F.sequence(first.cast("long"), F.greatest(first, end).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    plain = [k for k in samples.columns if k not in keep]
    placed = samples.select(*plain).join(by_record(length), list(keys)).select(*plain, *keep, "chosen_", F.explode(frames).alias("idx"))
    placed = placed.select(*plain, *keep, "idx", (F.array_position("chosen_", F.col("idx")) - 1).alias("number")).where("number >= 0")
    win = F.sort_array(F.collect_list(F.struct("n", "x"))).alias("win")
    out = placed.groupBy(*keys, "number", "idx").agg(*[F.min(k).alias(k) for k in keep], win).withColumn("win", F.col("win.x"))
    return out.select(*keys, *keep, "number", "idx", (F.col("idx") * hop).alias("start"), (F.col("idx") * hop + size).alias("stop"), "win")


def blocks(samples: DataFrame, size: int, before: int = 0, keys: Sequence[str] = RECORD) -> DataFrame:
    """Records cut into blocks: keys, block, blocks, start (of the array's samples), x (array). A block has `size` samples, the last one of a record up to
    twice as many, and the `before` samples before it. So a long record is never held by one task."""
    length = samples.groupBy(*keys).agg(F.count("*").alias("length_"))
    n = F.greatest(F.lit(1), F.floor(F.col("length_") / F.lit(size))).cast("long")
    own = F.least(F.floor(F.col("n") / F.lit(size)), F.col("blocks") - 1)
    reach = F.least(F.floor((F.col("n") + before) / F.lit(size)), F.col("blocks") - 1)
    placed = samples.select(*keys, "n", "x").join(length.select(*keys, n.alias("blocks")), list(keys)).select(*keys, "n", "x", "blocks", F.explode(F.sequence(own.cast("long"), reach.cast("long"))).alias("block"))
    rows = placed.groupBy(*keys, "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("s"))
    return rows.select(*keys, "block", "blocks", F.col("s")[0]["n"].alias("start"), F.col("s.x").alias("x"))


def chunks(frames: DataFrame, parts: int, keys: Sequence[str] = RECORD) -> DataFrame:
    """frames (idx from 0 without gaps) with chunk: which of `parts` consecutive slices of its record a frame is in, the first ones longer by one."""
    count = frames.groupBy(*keys).agg(F.count("*").alias("c_"))
    short, more = F.floor(F.col("c_") / F.lit(parts)), F.col("c_") % parts
    i, cut = F.col("idx"), more * (short + 1)
    chunk = F.when(i < cut, F.floor(i / (short + 1))).otherwise(more + F.floor(F.try_divide(i - cut, short)))
    return frames.join(count, list(keys)).withColumn("chunk", chunk.cast("int")).drop("c_")

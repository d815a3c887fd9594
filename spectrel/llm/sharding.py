"""Sharding by sampled splitters.

Rows are ordered by a key: the hash of the text (so that equal texts stand together), then a hash of the row's id. A sample in
which a row's chance grows with its size gives the key's quantiles as splitters of many ranges. The ranges' bytes are then counted
exactly; a range that is overfull is subdivided by a denser sample of its own, down to single keys. Within a range rows are numbered
and their sizes summed up; with the exact sums of the ranges before, every row has its place in the whole order, and the shards
are cut from it to equal bytes (or numbers of rows). The order depends on the rows alone, not on how they are read; rows of one key that
overfill a range are copies of one row, any of which may stand for any, and are numbered in parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectrel.llm.common import Shelf, free_name, read

#: Sampled keys for each range, as expected, and rows of a range as intended.
SAMPLES, RANGE_ROWS = 16, 1_000_000


def sample_keys(rows: DataFrame, total: int, samples: int, where=None, seed: int = 42) -> np.ndarray:
    """Distinct keys, drawn with a chance in proportion to the row's size, about as many as samples."""
    unit = (F.shiftrightunsigned(F.xxhash64("key", "tie", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    chosen = rows.where(unit < F.col("size") * (samples / max(1, total)))
    if where is not None:
        chosen = chosen.where(where)
    # distinct first: a key that many rows share comes to the driver once
    return np.sort(np.array([r[0] for r in chosen.select("key").distinct().collect()], dtype=np.int64))


def quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    at = (np.arange(1, parts) * len(keys)) // parts
    return np.unique(keys[at]) if len(keys) else keys


def ranges_of(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """rows and the number of the range of each: how many splitters its key reaches. splitters come from bounded samples."""
    held = rows.sparkSession.sparkContext.broadcast(splitters)

    @F.pandas_udf("int")
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, key.to_numpy(), side="right").astype(np.int32))

    return rows.withColumn("range", number("key"))


def shard(docs: DataFrame, shards: int = 8, law: str = "bytes", ranges: int | None = None, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep), size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text (a null has none) and 1; text_crc32: of the UTF-8 bytes, unsigned (a null as the empty text); shard: from 0, cut from the
    order of keys so that shards' bytes differ by less than two largest rows (law "bytes") or their numbers of rows by at most 1
    (law "rows"); slot: numbers the rows of a shard from 0 without gaps; grown_shard: null, the laws here don't depend on the key alone.
    Equal texts stand together, in one shard unless a cut falls among them. Repeated rows all get slots of their own. Null doc_ids
    are ordered like any. Columns of docs with the names of new ones are replaced; an empty table gives an empty table.
    """
    if law not in ("bytes", "rows") or shards < 1:
        raise ValueError("law is bytes or rows, and there is at least one shard")
    # ranges: how many, None for one for each RANGE_ROWS rows and 512 at least
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    shelf = Shelf(docs.sparkSession, "sharding")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    (inner,) = free_name(docs, "row")
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias(inner),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("a"),
        F.xxhash64(F.col(f"`{doc_id}`"), t, *[F.col(f"`{c}`") for c in kept]).alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("any"),
    )
    # the upper 36 bits of the text's hash and 28 of the row's: a group of equal texts can be split between its rows
    key = F.expr("(a & ~268435455L) | (tie & 268435455L)")
    rows = shelf.put(wide.withColumn("key", key).drop("a"))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ranges = ranges or max(512, -(-count // RANGE_ROWS))
    splitters = quantiles(sample_keys(rows, total, SAMPLES * ranges), ranges)
    # a row larger than a range has one of its own; there are fewer of them than ranges
    large = np.array([r[0] for r in rows.where(F.col("size") > max(1, total // ranges)).select("key").distinct().collect()], dtype=np.int64)
    splitters = np.union1d(splitters, np.append(large, large[large < np.iinfo(np.int64).max] + 1))
    turn = 0
    while True:  # every turn divides every overfull range, down to single keys
        sums = ranges_of(rows, splitters).groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        full = [r for r in sums if r["lo"] < r["hi"] and (r["size"] > 3 * total / ranges or r["n"] > 3 * count / ranges)]
        if not full:
            break
        weight = sum(max(r["size"], r["n"] * total // count) for r in full)
        inside = F.col("range").isin([r["range"] for r in full])
        more = sample_keys(ranges_of(rows, splitters).withColumn("size", F.greatest("size", F.lit(total // count))), weight, SAMPLES * ranges, inside, seed=turn)
        for r in full:
            own = more[(more > r["lo"]) & (more <= r["hi"])]
            share = 2 * max(1, r["size"] * ranges // max(1, total), r["n"] * ranges // count)
            splitters = np.union1d(splitters, quantiles(own, share) if len(own) else np.array([(r["lo"] + r["hi"]) // 2 + 1]))
        turn += 1
    # what overfills a range of one key is dealt out in parts
    heavy = {r["range"]: -(-r["n"] * ranges // (3 * count)) for r in sums if r["n"] > 3 * count / ranges} if count else {}
    numbered = ranges_of(rows, splitters).withColumn("sub", F.lit(0))
    if heavy:
        times = F.create_map(*[F.lit(v) for kv in heavy.items() for v in kv])[F.col("range")]
        numbered = numbered.withColumn("sub", F.coalesce(F.pmod(F.col("any"), times).cast("int"), F.lit(0)))
        sums = numbered.groupBy("range", "sub").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    before, bytes_, n = [], 0, 0
    for r in sorted(sums, key=lambda r: (r["range"], r["sub"] if heavy else 0)) if count else []:
        before.append((r["range"], r["sub"] if heavy else 0, bytes_, n))
        bytes_, n = bytes_ + r["size"], n + r["n"]
    if n != count:
        raise ValueError("the ranges don't hold every row")
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "range int, sub int, bytes_before long, rows_before long"))
    within = Window.partitionBy("range", "sub").orderBy("key", "tie", "text_crc32", "size")
    placed = numbered.withColumn("n", F.row_number().over(within)).withColumn("s", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.join(offsets, ["range", "sub"])
    place = F.col("rows_before") + F.col("n") - 1
    if law == "bytes":  # in whole numbers
        cut = F.expr(f"((2 * (bytes_before + s - size) + size) * {shards}) div {2 * max(1, total)}L")
    else:
        cut = F.expr(f"((rows_before + n - 1) * {shards}) div {max(1, count)}L")
    placed = shelf.put(placed.select(inner, "size", "text_crc32", place.alias("place"), F.least(cut, F.lit(shards - 1)).cast("int").alias("shard")))
    shelf.keep(placed)
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row a shard
    out = placed.join(F.broadcast(starts), "shard")
    return out.select(f"{inner}.*", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard() of all documents into 8 shards of equal bytes; edge cases as defined there."""
    return shard(read(spark, sf_dir, "documents"), keep=["doc_id"])

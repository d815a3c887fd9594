"""Lines that many documents share are dropped, but in one document.

Every line is normalised and hashed where its document is read; what is counted and joined are hashes (MD5 as 128 bits), never lines. A first pass
counts rows by hash, each line once a row, with the smallest and the largest doc_id; only hashes of enough rows go on. Their lines are looked up
with their positions, documents are counted exactly (a doc_id of several rows is one document), and each document gets the positions that it
loses. The text is split once more and put together from the positions that stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm.common import Shelf, free_name, lower_az, read, steps, text_bytes

#: ASCII white space, as in [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(BLANKS)))


def digest(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def without(text: bytes | None, lost: np.ndarray | None) -> tuple[int, bytes]:
    """The number of lines of a text, and its other lines, joined again."""
    lines = (text or b"").split(b"\n")
    n = len(lines)
    if lost is not None and len(lost):
        stays = np.ones(n, dtype=bool)
        stays[lost] = False
        lines = [lines[i] for i in np.flatnonzero(stays)]
    return n, b"\n".join(lines)


def line_dedup(docs: DataFrame, least: int = 20, documents: int = 3, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep), n_lines, n_dropped and kept_text: the text without the lines that other documents keep.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of `least` code points or more that `documents` documents or more
    have are dropped everywhere but in the largest doc_id that has them, where all lines with the key stay. n_lines counts before
    dropping.

    A null or empty text is one empty line. Rows with one doc_id are one document when documents are counted, and each is
    given without its lines; null doc_ids are one document, smaller than any other. Columns of docs with the names of new ones are replaced; an empty table
    gives an empty table.
    """
    new = ("n_lines", "n_dropped", "kept_text")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    shelf = Shelf(docs.sparkSession, "lines")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), digest(t).alias("th"), t.alias("t"))
    lines = rows.select("id", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = shelf.put(lines.where(F.length("key") >= least).select("id", "th", "pos", digest(F.col("key")).alias("h")))
    # a line that a row has twice counts twice here, so that this is an upper bound; nothing with enough documents is passed over
    often = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("none"))
    often = shelf.put(often.where((F.col("n") >= documents) & ((F.col("lo") < F.col("hi")) | F.col("none"))).drop("n"))
    held = shelf.put(lines.join(often, "h"))
    # by line and document first, so that a line of very many documents is dealt out
    pairs = held.groupBy("h", "id").agg(F.max("hi").alias("hi"))
    shared = pairs.groupBy("h").agg(F.count("*").alias("documents"), F.max("hi").alias("hi"))
    shared = shelf.put(shared.where(F.col("documents") >= documents).select("h", "hi"))
    lost = held.select("h", "id", "th", "pos").join(shared, "h").where(F.col("hi").isNotNull() & ~F.col("id").eqNullSafe(F.col("hi")))
    # repeated rows have the same positions; a document's are bounded by its lines
    lost = shelf.put(lost.groupBy("id", "th").agg(F.collect_set("pos").alias("lost")))
    key, key_digest, digested, gone, text_ = free_name(docs, "lost_id", "lost_digest", "digest", "lost", "kept")
    wide = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([doc_id, *kept])], digest(t).alias(digested), t.alias(text_))
    of = lost.select(F.col("id").alias(key), F.col("th").alias(key_digest), F.col("lost").alias(gone))
    joined = wide.join(of, F.col(f"`{doc_id}`").eqNullSafe(F.col(key)) & (F.col(digested) == F.col(key_digest)), "left").select(*[F.col(f"`{c}`") for c in kept], gone, text_)
    shelf.keep(lost)
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches):
        for whole in batches:
            for b in steps(whole, text_):
                positions = [None if p is None else np.array(p) for p in b.column(gone).to_pylist()]
                done = [without(x, p) for x, p in zip(text_bytes(b.column(text_)).to_pylist(), positions, strict=True)]
                dropped = [0 if p is None else len(p) for p in positions]
                arrays = [pa.array([n for n, _ in done], pa.int64()), pa.array(dropped, pa.int64()), pa.array([k for _, k in done], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *arrays], names=[*kept, *new])

    return joined.mapInArrow(run, schema)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_dedup() of all documents; the kept text as its SHA-256. Edge cases as defined there."""
    out = line_dedup(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, r, pos, line, shared.key IS NOT NULL AND k.doc_id <> keeper AS lost FROM k LEFT JOIN shared ON k.key = shared.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r
"""

"""Quality classification by importance resampling.

Two generative models of hashed byte n-grams, one of labelled good documents (the target) and one of all documents (raw), give every
n-gram the log of the ratio of its probabilities. An n-gram counts once for each document in a model. The target's share is smoothed with
the raw model: (t + a) / (r + a), where t and r are the number of target documents that have it and the number expected from the raw
model, so that n-grams too rare to tell are neutral. A document's log ratio is that of the two models over the whole text, by n-gram. A
few bad words in a long text hardly move it, so that passages have terms of their own: the smallest sum of log ratios over any window, for
windows of several sizes. Every term is measured from the median of held-out good documents in steps of how far their worst ones reach, and
the log weight is the smallest of them. Documents are drawn by Gumbel top-k: the k with the largest log weight / temperature +
Gumbel noise stay, where k is the number of documents whose log weight reaches what all but a small share of held-out good
documents reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm.common import Shelf, free_name, per_text, read, steps, text_bytes


@dataclass(frozen=True)
class QualityRule:
    """gram: bytes in an n-gram. bits: of the hash. smooth: a. windows: sizes of passages in n-grams. labelled: most labelled rows
    that the models are fitted and calibrated on (those with the smallest hash of their doc_id; half for each). lost: share of held-out
    good documents that may fall below the limit. temperature: of the draw, in steps of the log weight. seed: of the noise."""

    gram: int = 4
    bits: int = 20
    smooth: float = 0.5
    windows: tuple[int, ...] = (8, 48)
    labelled: int = 20_000
    lost: float = 0.005
    temperature: float = 0.02
    seed: int = 42


def grams(text: bytes | None, rule: QualityRule) -> np.ndarray:
    """The bucket of every n-gram of the text, which has a space added on both sides."""
    if not text:
        return np.empty(0, dtype=np.int32)
    b = np.frombuffer(b" " + text + b" ", dtype=np.uint8).astype(np.uint64)
    n = len(b) - rule.gram + 1
    if n < 1:
        return np.empty(0, dtype=np.int32)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(rule.gram):
        h = (h << np.uint64(8)) | b[i : n + i]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - rule.bits)).astype(np.int32)


def gram_counts(docs: DataFrame, text: str, rule: QualityRule) -> np.ndarray:
    """In how many rows of docs each bucket occurs. A task adds up its rows, so what is shuffled is at most a row a bucket and task, and
    what reaches the driver a row a bucket."""

    def run(batches):
        count = np.zeros(1 << rule.bits, dtype=np.int64)
        for whole in batches:
            for b in steps(whole, "text"):
                for t in text_bytes(b.column("text")).to_pylist():
                    g = np.sort(grams(t, rule))
                    if len(g):
                        count[g[np.r_[True, g[1:] != g[:-1]]]] += 1
        at = np.flatnonzero(count)
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(count[part])], names=["bucket", "n"])

    got = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << rule.bits, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, rule: QualityRule) -> np.ndarray:
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + rule.smooth) / (expected + rule.smooth)).astype(np.float32)


def terms(g: np.ndarray, ratio: np.ndarray, windows: tuple[int, ...]) -> list[float]:
    """The mean log ratio of all n-grams, and for each size the smallest sum over a window (of all n-grams where they are fewer); 0 where there are none."""
    if not len(g):
        return [0.0] * (1 + len(windows))
    c = np.empty(len(g) + 1)
    c[0] = 0
    np.cumsum(ratio[g], dtype=np.float64, out=c[1:])
    return [float(c[-1] / len(g)), *(float((c[w:] - c[:-w]).min()) if w < len(g) else float(c[-1]) for w in windows)]


def measured(docs: DataFrame, text: str, ratio, rule: QualityRule, name: str, keep: list[str]) -> DataFrame:
    """keep's columns and terms() of every whole text; ratio is a broadcast variable of a fixed size."""

    def make():
        return lambda texts: [[terms(grams(t, rule), ratio.value, rule.windows) for t in texts]]

    return per_text(docs, text, [(name, T.ArrayType(T.DoubleType()))], make, keep)


def scales(held: np.ndarray, lost: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(middle, step, limit) from the terms of held-out good documents: a term is (value - middle) / step, and the limit is what the smallest
    term of all but the share lost reaches."""
    middle = np.median(held, axis=0)
    step = np.maximum(middle - np.quantile(held, lost, axis=0, method="lower"), 1e-3)
    return middle, step, float(np.quantile(((held - middle) / step).min(axis=1), lost, method="lower"))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly, by counts in ever narrower bins; the last few thousand come to the driver."""
    lo, hi, above = *values.agg(F.min(column), F.max(column)).first(), 0
    while True:
        inside = values.where(F.col(column).between(lo, hi))
        step = (hi - lo) / 4096
        if not step > 0:
            return lo
        bin_ = F.least(F.floor((F.col(column) - lo) / step), F.lit(4095)).alias("bin")
        for b, n, least, most in sorted(inside.groupBy(bin_).agg(F.count("*"), F.min(column), F.max(column)).collect(), reverse=True):
            if above + n >= k:
                break
            above += n
        lo, hi = least, most
        if n <= 4096 or lo == hi:
            found = sorted((r[0] for r in values.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True) if n <= 4096 else []
            return found[k - above - 1] if found else lo


def resample(docs: DataFrame, labels: DataFrame, rule: QualityRule = QualityRule(), text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep), log_ratio (of the two models over the whole text, by n-gram), log_weight, gumbel_key and keep: whether the
    row is drawn.

    labels has doc_id, quality and toxic; a document is good if quality is 1 and toxic is 0, labels with a null are not used, of several
    labels of a doc_id the worst counts. A null, empty or very short text has no n-grams and is rated as a good document in the middle. Repeated rows
    have the same key and are drawn together, also where this makes more than k. A null doc_id has noise of its own, one for all. Without any
    good label all log weights are 0 and every row stays. Columns of docs with the names of new ones are replaced; an empty table gives
    an empty table.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "quality")
    new = ("log_ratio", "log_weight", "gumbel_key", "keep")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    (name,) = free_name(docs, "terms")
    label = labels.select(F.col(doc_id).alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).dropna()
    label = label.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(rule.labelled)
    label = shelf.put(label.withColumn("fit", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0))
    # at most rule.labelled rows
    marked = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(label), "id")
    target = gram_counts(marked.where("good and fit"), "text", rule)
    fitted = bool(target.any())
    raw = gram_counts(docs, text, rule) if fitted else target
    ratio = spark.sparkContext.broadcast(log_ratios(target, raw, rule) if fitted else np.zeros(1 << rule.bits, dtype=np.float32))
    # where doc_ids repeat, those with the smallest hashes
    out_of_fit = marked.where("good and not fit").withColumn("h", F.xxhash64("id", "text"))
    found = measured(out_of_fit, "text", ratio, rule, "w", ["h"]).orderBy("h").limit(rule.labelled).select("w").collect()
    middle, step, limit = scales(np.array([r[0] for r in found] or [[0.0] * (1 + len(rule.windows))]), rule.lost)
    weight = F.least(*[(F.col(name)[i] - float(m)) / float(s) for i, (m, s) in enumerate(zip(middle, step, strict=True))])
    weight = F.when(F.forall(F.col(name), lambda x: x == 0), F.lit(0.0)).otherwise(weight)
    scored = measured(docs, text, ratio, rule, name, list(dict.fromkeys([doc_id, *kept])))
    unit = (F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`"), F.lit(rule.seed)), 11) + 0.5) / float(1 << 53)
    scored = scored.withColumns({"log_ratio": F.col(name)[0], "log_weight": weight}).drop(name).withColumn("gumbel_key", F.col("log_weight") / rule.temperature - F.log(-F.log(unit)))
    slim = shelf.put(scored.select(F.col(f"`{doc_id}`").alias("id"), "log_ratio", "log_weight", "gumbel_key"))
    k = slim.where(F.col("log_weight") >= min(limit, 0.0)).count()
    least = kth_largest(slim, "gumbel_key", k) if k else float("inf")
    bare = set(kept) <= {doc_id}
    shelf.keep(*[slim] * bare)
    out = slim.withColumnRenamed("id", doc_id) if bare else scored
    return out.select(*[F.col(f"`{c}`") for c in kept], *new[:3], (F.col("gumbel_key") >= least).alias("keep"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample() over all documents and labels; edge cases as defined there."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])

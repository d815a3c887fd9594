"""Benchmark decontamination by winnowing.

Every k consecutive words have a hash; of every w consecutive hashes the smallest (the last of equals) is kept. Two texts that
share a span of k + w - 1 words keep the same hash at the same place of it, so with k + w - 1 = 13 no shared window of 13 words is
missed. Kept hashes of documents that a Bloom filter of the benchmark's kept hashes lets through carry the 13 - k words on both
sides; they are joined with the benchmark's, and a hit is extended over those words, exactly, word by word: if it reaches 13
words, they are hit. A benchmark item of fewer words is one window; all its words are looked up by a hash of as many words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm.common import LOWER_AZ, UPPER_AZ, WORD_PATTERN, Shelf, WordHashes, alnum_words, free_name, gram_hashes, per_text, read

WINDOW = 13
GRAM = 7
#: Bits of the Bloom filter for each gram of the benchmark, and the fewest and most bits (1 and 32 MB, which is what is broadcast).
#: From some 16 million grams on it lets more through needlessly; that costs time only.
BLOOM_PER_GRAM, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 23, 1 << 28


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the hashes that winnowing keeps: the smallest of every w, the last of equals; of fewer than w none."""
    if len(h) < w:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    at = w - 1 - np.argmin(view[:, ::-1], axis=1) + np.arange(len(view))
    return np.unique(at)


def candidates(words: list[bytes], hashes: np.ndarray, shorts: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, places, length) of the winnowed k-grams, and for each length of short items of all its grams."""
    h = gram_hashes(hashes, GRAM)
    at = winnow(h, WINDOW - GRAM + 1)
    out = [(h[at], at, GRAM)]
    for n in shorts:
        g = gram_hashes(hashes, n)
        out.append((g ^ np.uint64(0x5851F42D4C957F2D), np.arange(len(g)), n))
    return out


class Bloom:
    """A Bloom filter of hashes, four places for each."""

    def __init__(self, bits: int):
        self.bits, self.field = bits, np.zeros(bits // 64, dtype=np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for i in range(4):
            at = (h >> np.uint64(i * 11)) & np.uint64(self.bits - 1)
            out &= self.field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
        return out


HIT = T.StructType([T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("after", T.StringType())])


def _hits(words: list[bytes], found: list[tuple[np.ndarray, np.ndarray, int]], short: bool | None = None) -> list[dict]:
    out = []
    for h, at, n in found:
        reach = WINDOW - n if n == GRAM and not short else 0
        for x, p in zip(h.view(np.int64).tolist(), at.tolist(), strict=True):
            cut = lambda a, b: b" ".join(words[max(0, a) : b]).decode("utf-8", "replace")
            out.append({"h": x, "at": p, "n": n, "before": cut(p - reach, p), "gram": cut(p, p + n), "after": cut(p + n, p + n + reach)})
    return out


def item_grams(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row for each kept gram of an item: item, h, n, short, before, gram, after."""

    def make():
        known = WordHashes()

        def do(texts):
            rows = []
            for t in texts:
                w = alnum_words(t)
                x = known.of(w)
                if len(w) >= WINDOW:
                    got = [{**r, "short": False} for r in _hits(w, candidates(w, x, [])[:1])]
                elif w:
                    got = [{**r, "short": True} for r in _hits(w, candidates(w, x, [len(w)])[1:], True)]
                else:
                    got = []
                rows.append(got)
            return [rows]

        return do

    kind = T.ArrayType(T.StructType([*HIT.fields, T.StructField("short", T.BooleanType())]))
    (name,) = free_name(items, "grams")
    made = per_text(items, text, [(name, kind)], make, [item_id])
    return made.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.explode(f"`{name}`").alias("g")).select("item", "g.*")


def bloom_of(grams: DataFrame) -> Bloom:
    """The Bloom filter of h, sized by the number of grams; its words of 64 bits with set places come to the driver."""
    wanted = BLOOM_PER_GRAM * grams.count()
    out = Bloom(min(BLOOM_MOST, max(BLOOM_LEAST, 1 << wanted.bit_length())))
    places = [F.shiftrightunsigned("h", i * 11).bitwiseAND(F.lit(out.bits - 1)) for i in range(4)]
    at = grams.select(F.explode(F.array(*places)).alias("p")).select(F.expr("p >> 6").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    got = at.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out.field[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep), n_words, n_hit (words inside any occurrence of an item's window), items (sorted ids of the items that
    occur, as strings), n_items, and contaminated: n_hit > 0 and 20 * n_hit >= n_words.

    A null or empty text has no words and is clean; items without words are no windows; a null item_id takes part as the string "null".
    Rows that repeat are judged each; items with the same id count once. Columns of docs with the names of new ones are replaced.
    Empty tables: an empty result, or all clean.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession, "decontam")
    new = ("n_words", "n_hit", "n_items", "items", "contaminated")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    grams = shelf.put(item_grams(items.withColumn(item_id, F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null"))), item_id, item_text))
    shorts = sorted(r.n for r in grams.where("short").select("n").distinct().collect())  # at most 12 lengths
    bloom = spark.sparkContext.broadcast(bloom_of(grams))
    name, words_name, row = free_name(docs, "grams", "words", "row")

    def make():
        known = WordHashes()

        def do(texts):
            counts, rows = [], []
            for t in texts:
                w = alnum_words(t)
                found = []
                for h, at, n in candidates(w, known.of(w), shorts):
                    let = bloom.value.has(h)
                    found.append((h[let], at[let], n))
                counts.append(len(w))
                rows.append(_hits(w, found[:1]) + _hits(w, found[1:], True))
            return [counts, rows]

        return do

    made = per_text(docs, text, [(words_name, T.LongType()), (name, T.ArrayType(HIT))], make, kept)
    # one table holds what follows needs of each row: its number of words and the few grams the filter let through
    pos = shelf.put(made.withColumnRenamed(words_name, "n_words").withColumn(row, F.monotonically_increasing_id()))
    one = pos.where(F.size(f"`{name}`") > 0).select(F.col(f"`{row}`").alias("r"), F.explode(f"`{name}`").alias("d"))
    hits = one.select("r", "d.*").join(grams.select("item", F.col("h").alias("gh"), F.col("n").alias("gn"), F.col("before").alias("gb"), F.col("gram").alias("gg"), F.col("after").alias("ga"), "short"), (F.col("h") == F.col("gh")) & (F.col("gram") == F.col("gg")) & (F.col("n") == F.col("gn")))
    hits = hits.select("r", "at", "n", "item", "short", _common("before", "gb", True).alias("left"), _common("after", "ga", False).alias("right"))
    hits = hits.where(F.col("short") | (F.col("left") + F.col("n") + F.col("right") >= WINDOW))
    spans = hits.select("r", "item", (F.col("at") - F.col("left")).alias("a"), (F.col("at") + F.col("n") + F.col("right")).alias("b"))
    spans = shelf.put(spans.distinct())
    ids = spans.select("r", "item").distinct().groupBy("r").agg(F.sort_array(F.collect_list("item")).alias("items"))
    # words covered by any span: of spans in order, what each adds beyond the furthest end before it
    cover = spans.groupBy("r").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s"))
    cover = cover.select("r", F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")))["n"].alias("n_hit"))
    both = shelf.put(ids.join(cover, "r"))
    shelf.keep(pos, both)
    out = pos.drop(name).join(both, F.col(f"`{row}`") == F.col("r"), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    found = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """docs without those that decontaminate() finds contaminated, as they are. Being contaminated depends on the text alone."""
    ka, kb, xa, xb = free_name(docs, "key_a", "key_b", "xa", "xb")
    keyed = docs.select("*", F.xxhash64(text).alias(ka), F.xxhash64(text, F.lit(1)).alias(kb))
    found = decontaminate(keyed.select(F.col(f"`{text}`").alias("text"), F.col(ka).alias("ka"), F.col(kb).alias("kb")), items, doc_id="ka", keep=["ka", "kb"], **names)
    bad = found.where("contaminated").select(F.col("ka").alias(xa), F.col("kb").alias(xb)).distinct()
    return keyed.join(bad, [F.col(ka) == F.col(xa), F.col(kb) == F.col(xb)], "left_anti").select(*[f"`{c}`" for c in docs.columns])


def _common(a: str, b: str, from_end: bool):
    """How many words two strings have in common, from the end or the start."""
    x, y = (F.filter(F.split(c, " "), lambda w: w != "") for c in (a, b))
    if from_end:
        x, y = F.reverse(x), F.reverse(y)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate() of all documents by all benchmark items, items as a digest; edge cases as defined there."""
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '{WORD_PATTERN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '{WORD_PATTERN}') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bg) WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
h AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""

"""Audit of how filters interact: what each of them removes in every order in which they can be applied.

An order is a path through the lattice of sets of filters: from the empty set, each step adds one filter. What a step does depends only on
the edge that it takes, that is on the set already applied and the filter that comes next; five filters have 80 edges and 120 orders of
five steps. Documents that fail the same filters, in the same part, and carry the same labels do the same on every edge, so that they are counted
first (at most 32 rows a part and task), and these counts contribute to all edges. The edges, a few for each part, are then joined to the
steps of all orders.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.llm.common import Shelf, read

#: ASCII white space as a pattern; what stands between it are words.
BLANK = r"[\x20\x09-\x0D]+"


def text_conditions(text: Column) -> dict[str, Column]:
    """When a text fails: A under 200 words, B under half of its words distinct, C over 3 % capital letters, D any of the signs #$%&*|."""
    words = F.array_remove(F.split(text, BLANK), "")
    count = lambda c: c.cast("long")
    return {
        "A": F.size(words) < 200,
        "B": 100 * count(F.size(F.array_distinct(words))) < 50 * count(F.size(words)),
        "C": 100 * count(F.regexp_count(text, F.lit("[A-Z]"))) > 3 * count(F.length(text)),
        "D": text.rlike(r"[#$%&*|]"),
    }


def edges(letters: str) -> list[tuple[int, int, str]]:
    """(applied, bit, letter) of every edge: the set already applied as bits, the bit of the next filter and its letter."""
    bit = {x: 1 << i for i, x in enumerate(letters)}
    return [(sum(bit[y] for y in some), bit[x], x) for x in letters for n in range(len(letters)) for some in combinations(letters.replace(x, ""), n)]


def order_steps(letters: str) -> list[tuple[str, int, int, str]]:
    """(filter_order, step, applied, letter) of every step of every order; applied as in edges()."""
    bit = {x: 1 << i for i, x in enumerate(letters)}
    return [("".join(p), i + 1, sum(bit[x] for x in p[:i]), p[i]) for p in permutations(letters) for i in range(len(letters))]


def interaction_audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None, copies: str | None = "E", part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: a row for each part, order and step.

    conditions: for every filter's letter when a row of docs fails it (None: text_conditions of the text); copies: the letter of the filter that fails
    a row whose whole text (compared by SHA-256) stands in a row with a smaller doc_id, None for no such filter. At most six filters. part: the values of this
    column as strings, a null as the empty string.

    A null text is the empty text. A condition that is null isn't failed. A row with a null doc_id is no copy and makes no copies, and has no
    labels. Repeated rows (of one doc_id) are counted each, and aren't copies of each other. Of several labels of a doc_id any with quality 1, and any with toxic
    1, counts. Columns of docs with other names don't matter; an empty table gives an empty table.
    """
    shelf = Shelf(docs.sparkSession, "audit")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    failing = dict(text_conditions(t) if conditions is None else conditions)
    letters = "".join(sorted({*failing, *([copies] if copies else [])}))
    if len(letters) > 6 or any(len(x) != 1 for x in failing) or copies in failing:
        raise ValueError("up to six filters, each with a letter of its own")
    bit = {x: 1 << i for i, x in enumerate(letters)}
    mask = F.lit(0)
    for x, c in failing.items():
        mask = mask + F.when(c, bit[x]).otherwise(0)
    facts = docs.select(
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{doc_id}`").alias("id"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("h"),
        mask.alias("mask"),
    )
    facts = shelf.put(facts)
    # the right sides of both joins are tables of their own, so that adaptive execution can split a text or doc_id with many rows
    mark = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = shelf.put(labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic")))
    judged = facts
    if copies:
        firsts = shelf.put(facts.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
        judged = facts.join(firsts, "h", "left").withColumn("mask", F.col("mask") + F.when(F.col("id") > F.col("first"), bit[copies]).otherwise(0))
    judged = judged.join(known, "id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    alike = judged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    each = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit"), F.lit(x).alias("filter")) for s, b, x in edges(letters)])
    on = alike.select("*", F.explode(each).alias("e")).select("*", "e.*")
    passed, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    edge = on.groupBy("part", "applied", "filter").agg(
        total(passed & ~fails).alias("kept"),
        total(passed & fails).alias("removed"),
        total(~passed & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(passed & fails, "good").alias("good_lost"),
        total(passed & fails, "toxic").alias("toxic_lost"),
    )
    edge = shelf.put(edge)
    shelf.keep(edge)
    steps = docs.sparkSession.createDataFrame(order_steps(letters), "filter_order string, step int, applied int, filter string")
    paths = edge.join(F.broadcast(steps), ["applied", "filter"])  # 600 rows for five filters, 4,320 at most
    shapley = paths.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return paths.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """interaction_audit() of all documents with five filters, by language; edge cases as defined there."""
    return interaction_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), alike AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)
), steps AS (
  SELECT o AS filter_order, s AS step, substr(o, s, 1) AS filter, substr(o, 1, s - 1) AS before FROM orders, generate_series(1, 5) AS g(s) WHERE length(o) = 5
), done AS (
  SELECT part, filter_order, step, filter, fails, n, good, toxic, contains(fails, filter) AS here, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS earlier
  FROM alike, steps
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
    CAST(sum(CASE WHEN NOT here AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM done GROUP BY part, filter_order, step, filter
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted
"""

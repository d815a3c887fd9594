"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from spectrel.llm import ann, decontam, licenses, lm, piecebpe, quality, sharding, simhash, tokencount, urlfilter
from spectrel.llm.common import tokenizer_file

CLASHES = ("fp", "wide", "row", "ka", "kb", "key_a", "key_b", "grams", "words", "n", "item", "keep", "shard", "part", "block", "worst", "h", "id", "range", "size", "root", "label", "host", "text_", "n_words", "score", "bucket")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])


def rows():
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    long = " ".join(word() for _ in range(60_000))
    normal = " ".join(word() for _ in range(200))
    base = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, normal), (5, normal), (5, normal), (None, normal), (None, None), (6, normal + " end"), (7, "mit license"), (8, "a b"), (9, "ÄÖ ü 日本 \x00 x"), (10, "apache license, version 2.0 cc by"), (5, "other text of the same id")]
    return [(i, t, "en", "s", None, *["x"] * len(CLASHES)) for i, t in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    t = rows()[4][1].split()
    return spark.createDataFrame([(1, " ".join(t[20:50]), "x"), (2, None, "x"), (3, "", "x"), (4, "b a", "x"), (1, " ".join(t[20:50]), "x"), (None, "日本", "x")], "item_id long, text string, h string")


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (4, 1, 0), (9, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda s, d, i: simhash.simhash_components(d),
    "simhash_near": lambda s, d, i: simhash.simhash_components(d, simhash.NEAR),
    "decontam": lambda s, d, i: decontam.decontaminate(d, i),
    "lm": lambda s, d, i: lm.backoff_scores(d),
    "licenses": lambda s, d, i: licenses.license_scan(d),
    "pieces": lambda s, d, i: piecebpe.encode_decode(d, tokenizer_file("piece_bpe_32k.model")),
    "sharding": lambda s, d, i: sharding.shard(d),
    "sharding_rows": lambda s, d, i: sharding.shard(d, law="rows"),
    "tokens": lambda s, d, i: tokencount.token_counts(d, tokenizer_file("byte_bpe_50k.json")),
    "quality": lambda s, d, i: quality.resample(d, labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, docs, items, name):
    out = OPERATORS[name](spark, docs, items).collect()
    assert len(out) == len(rows())
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, items, name):
    out = OPERATORS[name](spark, empty, items)
    assert out.collect() == [] and "doc_id" in out.columns


def test_defined_values(spark, docs, items):
    by = {}
    for r in simhash.simhash_components(docs).collect():
        by.setdefault(r.text, set()).add((r.fingerprint, r.component_id))
    zero = {("0" * 16, 1)}
    assert by[None] == by[""] == by[" \t\n"] == zero
    assert {c for _, c in by[rows()[4][1]]} == {5}
    got = {(r.doc_id, r.text): r for r in decontam.decontaminate(docs, items).collect()}
    normal = got[5, rows()[4][1]]
    assert normal.n_hit == 30 and normal["items"] == ["1"] and normal.contaminated
    assert got[8, "a b"].n_hit == 0 and got[1, None].n_words == 0 and not got[1, None].contaminated
    assert got[9, rows()[12][1]]["items"] == ["null"]
    scan = {(r.doc_id, r.text): r for r in licenses.license_scan(docs).collect()}
    assert scan[1, None].labels == "" and scan[1, None].score == 0 and scan[1, None].first_word is None
    assert scan[7, "mit license"].base_labels == "mit" and scan[7, "mit license"].first_word == 0
    x = scan[10, rows()[13][1]]
    assert x.base_labels == "apache,cc-by" and x.n_base == 2 and (x.first_word, x.last_word) == (0, 5) and "apache-2.0" in x.labels
    score = {(r.doc_id, r.text): r for r in lm.backoff_scores(docs).collect()}
    assert score[2, ""].total == 0 and score[2, ""].score is None and score[4, rows()[3][1]].n_words == 60_000
    weight = {(r.doc_id, r.text): r for r in quality.resample(docs, labels(spark)).collect()}
    assert weight[1, None].log_weight == 0 and weight[2, ""].log_weight == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, empty, tmp_path, items, name, stage):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    kept = out.collect()
    assert 0 < len(kept) <= len(rows())
    if name != "encoded":
        assert out.columns == docs.columns
    assert stage(spark, empty, str(tmp_path)).collect() == []


def test_dedup_keeps_one_of_each_group(spark, docs):
    kept = [(r.doc_id, r.text) for r in simhash.near_dedup(docs).collect()]
    normal = rows()[4][1]
    assert kept.count((5, normal)) == 1 and (None, normal) not in kept and (6, normal + " end") not in kept
    assert sum(t in (None, "", " \t\n") for _, t in kept) == 1 and (5, "other text of the same id") in kept and (4, rows()[3][1]) in kept


def test_vectors(spark):
    v = lambda *x: [float(i) for i in x]
    data = [(0, v(1, 0, 0), 1), (1, v(1, 0, 0), 1), (1, v(1, 0, 0), 1), (2, None, 1), (3, v(0, 0, 0), 1), (4, [1.0, None, 0.0], 1), (5, v(float("nan"), 1, 1), 1), (6, v(float("inf"), 1, 1), 1), (7, v(0, 1, 0), 1), (8, v(1, 1), 1), (None, v(1, 0, 0), 1), (100, v(0, 0, 2), 1), (9, [], 1)]
    t = spark.createDataFrame(data, "vec_id long, embedding array<float>, part int")
    out = ann.nearest(t, t.vec_id % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in out] == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 7, 1.414214), (0, 4, 100, 2.236068), (100, 1, 0, 2.236068), (100, 2, 1, 2.236068), (100, 3, 1, 2.236068), (100, 4, 7, 2.236068)]
    assert ann.nearest(t.limit(0), t.vec_id % 100 == 0).collect() == []


def test_urls(spark):
    data = [(1, None, None, "x"), (2, "nothing", "", "x"), (3, "http://A.COM/x?y", '<a href="//b.org/">', "x"), (4, "https://www.example.com/en/1", None, "x"), (5, "ftp://m.example.com/en/#z", None, "x"), (6, "http://x.net/es/", None, "x"), (7, "http://com", None, "x"), (1, None, None, "x")]
    t = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    out = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(t).collect())
    assert out == [(1, "", "", None, "allow")] * 2 + [(2, "", "", None, "allow"), (3, "a.com", "/x", "com/", "allow"), (4, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (5, "m.example.com", "/en/", "example.com/en/", "block"), (6, "x.net", "/es/", "net/es/", "block"), (7, "com", "", None, "allow")]
    assert urlfilter.judge_urls(t.limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("simhash_near", "sharding_rows")])
def test_a_text_of_ten_megabytes(spark, items, name):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=1_500_000))
    out = OPERATORS[name](spark, spark.createDataFrame([(1, long), (2, "short"), (3, long + " more")], "doc_id long, text string"), items).collect()
    assert len(long) > 10_000_000 and sorted(r.doc_id for r in out) == [1, 2, 3]

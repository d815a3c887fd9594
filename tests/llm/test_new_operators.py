"""Filter audit, whitening and line dedup against plain restatements, with nulls, long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm import queries
from spectrel.llm.audit import interaction_audit
from spectrel.llm.linededup import line_dedup
from spectrel.llm.whitening import whiten

CLASHES = ("h", "id", "mask", "first", "last", "good", "toxic", "n", "part", "t", "th", "pos", "line", "key", "lost", "lost_id", "digest", "kept", "n_lines", "x", "w", "v", "k", "c0", "component", "deviation")
WHITE = " \t\n\x0b\x0c\r"


def words(t):
    for c in WHITE[1:]:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


# ---- filter audit


def audit_by_hand(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Every order is applied to every document in turn."""
    ids = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].append(i)
    facts = []
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            fails.add("C")
        if any(c in t for c in "#$%&*|"):
            fails.add("D")
        if i is not None and any(j < i for j in ids[t]):
            fails.add("E")
        own = [x for x in labels if i is not None and x[0] == i]
        facts.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, defaultdict(int)
    for part in {f[0] for f in facts}:
        for order in permutations("ABCDE"):
            alive = [f for f in facts if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                here = [f for f in alive if x in f[1]]
                redundant = sum(x in f[1] for f in gone)
                alive, gone = [f for f in alive if x not in f[1]], gone + here
                unique = sum(f[1] == {x} for f in facts if f[0] == part)
                out[part, "".join(order), step] = [len(alive), len(here), redundant, unique, sum(f[2] for f in here), sum(f[3] for f in here)]
                total[part, x] += len(here)
    return {k: tuple(v + [total[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def audit_rows(df):
    got = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


def audit_docs():
    rng = random.Random(3)
    many = " ".join(f"w{i}" for i in range(230))
    poor = " ".join(f"w{i % 90}" for i in range(230))
    loud = " ".join(f"W{i}" for i in range(230))
    odd = ["", None, " \t\x0b\n", many, poor, loud, many + " #", "a\x00b é 日本 😀 $", " ".join(["x"] * 400), many.replace(" ", "\x0b"), many + "  z", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 100}" for i in range(200)), "A" * 3 + "b" * 97, "A" * 4 + "b" * 96]
    docs = [(i, rng.choice(odd), rng.choice(["en", "de", None, ""])) for i in range(60)]
    return docs + [(None, many, "en"), (None, many, "en"), (7, many, "fr"), (7, many, "en"), (1000, "tail " * 200_000, "de"), (-5, poor, "de")]


def test_audit_by_hand(spark):
    docs = audit_docs()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 50, 2)] + [(7, None, 1), (7, 1, None), (None, 1, 1), (8, 0, 0), (8, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    names = [c for c in CLASHES if c != "lang"]
    table = spark.createDataFrame([(*d, *["z"] * len(names)) for d in docs], ", ".join(["doc_id long", "text string", "lang string", *[f"{c} string" for c in names]]))
    got = audit_rows(interaction_audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == audit_by_hand(docs, labels)
    assert len(got) == 4 * 600


def test_audit_of_nothing_and_of_other_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a", "en"), (2, "b", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    assert interaction_audit(docs.limit(0), labels).collect() == []
    got = audit_rows(interaction_audit(docs, labels, {"X": F.col("text") == "a", "Y": F.col("doc_id") < 3}, copies=None))
    assert got == {("en", "XY", 1): (2, 1, 0, 0, 0, 0, 1), ("en", "XY", 2): (1, 1, 1, 1, 0, 0, 3), ("en", "YX", 1): (1, 2, 0, 1, 0, 0, 3), ("en", "YX", 2): (1, 0, 1, 0, 0, 0, 1)}
    with pytest.raises(ValueError):
        interaction_audit(docs, labels, {x: F.lit(True) for x in "STUVWX"})


def test_audit_steps_add_up(spark, small):
    """Whatever the order, the same documents stay in the end, and what its steps remove and keep adds up to the part."""
    got = queries.QUERIES["op11_filter_audit"](spark, small).toPandas()
    size = spark.read.parquet(f"{small}/documents.parquet").groupBy("lang").count().toPandas().set_index("lang")["count"]
    for (part, _), order in got.groupby(["part", "filter_order"]):
        order = order.sort_values("step")
        assert order.removed.sum() + order.kept.iloc[-1] == size[part]
        assert (order.kept == size[part] - order.removed.cumsum()).all()
    assert got[got.step == 5].groupby("part").kept.nunique().eq(1).all()
    # Shapley sums to what all filters remove together, over all orders
    for part, rows in got.groupby("part"):
        assert rows.drop_duplicates("filter").shapley.sum() == 120 * (size[part] - rows[rows.step == 5].kept.iloc[0])


# ---- line dedup


def dedup_by_hand(docs, least=20, documents=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stays = []
        for line in lines:
            who = holders.get(key(line), set())
            largest = max((x for x in who if x is not None), default=None)
            if len(who) < documents or i == largest or largest is None:
                stays.append(line)
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=str)


def line_docs():
    rng = random.Random(11)
    shared = ["this line is in many documents", "  THIS line is in many documents\t", "This Line Is In Many Documents\x0b", "short one", "exactly twenty chars", "nineteen characters", "日本語" * 7, "É" * 20, "é" * 20, "a line of two documents only", "", " this line is in many documents ", "tab\x1cwithin this line of text"]
    docs = [(i, "\n".join(rng.choices(shared, k=rng.randint(0, 9)) + [f"own line number {i} of the document"] * rng.randint(0, 2))) for i in range(40)]
    docs += [(50, "a line of two documents only too\n" * 3), (50, "a line of two documents only too"), (51, "a line of two documents only too\n")]  # two documents in three rows
    docs += [(60, "a line with a null among its documents"), (61, "a line with a null among its documents"), (None, "a line with a null among its documents\nand more")]
    docs += [(70, "the same row again and again"), (70, "the same row again and again"), (71, "the same row again and again"), (72, "the same row again and again")]
    docs += [(80, None), (81, ""), (82, "\n\n"), (None, None), (None, "x" * 30), (None, "x" * 30), (90, "y " * 300_000 + "\n" + "this line is in many documents\n" * 50_000)]
    return docs


def test_lines_by_hand(spark):
    docs = line_docs()
    names = [c for c in CLASHES if c not in ("n_lines",)]
    table = spark.createDataFrame([(*d, *["z"] * len(names), 5) for d in docs], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in names], "N_LINES int"]))
    out = line_dedup(table)
    assert out.columns == [c for c in table.columns if c != "N_LINES"] + ["n_lines", "n_dropped", "kept_text"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=str)
    assert got == dedup_by_hand(docs)
    assert line_dedup(table.limit(0)).collect() == []
    # any line of one document or more goes, but where the largest doc_id has it
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(table, least=1, documents=1, keep=["doc_id"]).collect()), key=str)
    assert got == dedup_by_hand(docs, 1, 1)


def test_lines_query(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_line_dedup"](spark, small).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    want = sorted(((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in dedup_by_hand(docs)), key=str)
    assert got == want and sum(r[2] for r in got) > 0


# ---- whitening


def whiten_by_hand(vectors, scale=256):
    """x, n, deviations (Python integers), eigenvalues falling, eigenvectors, trace."""
    x = np.array([[math.floor(scale * c) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.astype(object).sum(axis=0)]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = fit - np.array([float(Fraction(s, n)) for s in sums])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, deviation, e[::-1], axes[:, ::-1], centred


def check_whitening(got, ids, vectors, components=4):
    x, n, sums, deviation, e, axes, centred = whiten_by_hand(vectors)
    at = {i: k for k, i in enumerate(ids)}
    assert len(got) == components * len(ids)
    for k in range(1, components + 1):
        rows = [r for r in got if r.component == k]
        mine = np.array([r.whitened for r in rows])
        want = np.array([(x[at[r.vec_id]] - np.array(sums) / n) @ axes[:, k - 1] / math.sqrt(e[k - 1]) for r in rows])
        assert np.abs(mine * np.sign(mine @ want) - want).max() < 1e-8
        assert all(r.n == n and r.deviation == deviation[at[r.vec_id]] for r in rows)
        assert all(abs(r.explained / (e[k - 1] / e.sum()) - 1) < 1e-10 for r in rows)
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-8


def test_whitening_query(spark, small):
    got = queries.QUERIES["op12_whitening"](spark, small).collect()
    table = [r for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(got, [r[0] for r in table], [r[1] for r in table])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [[float(c) for c in rng.normal(scale=s)] for s in [np.array([3.0, 2.0, 1.0, 0.5, 0.3])] * 60]
    good[10:40] = [good[10]] * 30  # half of the rows are one vector
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [-0.0, 1e300, 0.0, 0.0, 0.0]]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.StringType()) for c in CLASHES]])
    table = spark.createDataFrame([(i, v, *["z"] * len(CLASHES)) for i, v in enumerate(good + odd)], schema)
    out = whiten(table)
    assert out.columns == ["vec_id", "embedding", *[c for c in CLASHES if c not in ("n", "component", "deviation")], "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(out.collect(), list(range(60)), good)
    twice = whiten(table.select("vec_id", "embedding").union(table.select("vec_id", "embedding")), keep=["vec_id"]).collect()
    assert len(twice) == 2 * 4 * 60 and {r.n for r in twice} == {31}
    assert whiten(table.limit(0)).collect() == [] and whiten(table.where("vec_id between 10 and 20")).collect() == []
    assert whiten(table.where("vec_id between 60 and 64")).collect() == []
    plane = spark.createDataFrame([(i, [float(i), 2.0 * i, float(i % 3), 0.0, 0.0, 0.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {r.component for r in whiten(plane).collect()} == {1, 2}  # the others have no variance


def test_whitening_beyond_64_bits(spark):
    vectors = [[1e14, 1.0], [-1e14, 2.0], [3e13, 5.0], [0.0, 1.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whiten(table, components=1).collect()
    *_, deviation, e, _, _ = whiten_by_hand(vectors)
    assert all(d >= 1 << 63 for d in deviation[:2]) and [r.deviation for r in sorted(got)] == [d if d < 1 << 63 else None for d in deviation]
    assert abs(got[0].explained - 1) < 1e-9

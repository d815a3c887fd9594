"""What keeps queries in their limits on larger tables: plans without joins of samples, work dealt to tasks, and the same rows as before."""

import pytest

from spectrel.plans import all_queries
from spectrel.plans.registry import QUERIES

all_queries.load()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["h09_noisy_tone", "h09_recovery", "h08_rate_sweep", "h08_snr_sweep", "h08_bit_sweep"])
def test_suppliers_samples_are_joined_with_nothing(spark, small, name):
    """The samples of the suppliers' tones are made in their rows, by several tasks; the size of the suppliers' table made Spark broadcast them."""
    text = plan(QUERIES[name](spark, small))
    assert "Join" not in text and "Repartition" in text


def test_chosen_windows_are_looked_up_in_the_record_row(spark):
    """Which frames are chosen is found once a record, not by an expression of the length for every sample and frame."""
    from pyspark.sql import functions as F

    from spectrel.operators.framing import sampled_windows

    lengths = [("a", 15), ("b", 16), ("c", 24), ("d", 72), ("e", 80), ("f", 1000), ("g", 1003)]
    s = spark.createDataFrame(lengths, "group_id string, size long").select("group_id", F.lit("L").alias("part"), F.lit("x").alias("label"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("n")).withColumn("x", F.col("n").cast("double"))
    for most in (1, 2, 7):
        out = sampled_windows(s, 16, 8, most)
        assert plan(out).count("ceil") <= 2  # of the sample's frames only
        got = {(r.group_id, r.number, r.idx): r.win for r in out.collect()}
        want = {}
        for g, size in lengths:
            c = (size - 16) // 8 + 1 if size >= 16 else 0
            idx = list(range(c)) if c <= most else [0] if most == 1 else [int(j * ((c - 1) / (most - 1))) for j in range(most - 1)] + [c - 1]
            want |= {(g, j, i): [float(i * 8 + m) for m in range(16)] for j, i in enumerate(idx)}
        assert got == want


def test_numbering_by_more_tasks_gives_the_same_series(spark, small, monkeypatch):
    """Tasks that number series follow from the table's lines; samples meet their records' facts by hash, unsorted."""
    from spectrel.operators import conditioning as co
    from spectrel.plans import fixtures

    few = fixtures.ship_series(spark, small)
    monkeypatch.setattr(fixtures, "LINES", 500)
    many = fixtures.ship_series(spark, small)
    assert "RepartitionByExpression" in plan(many) and "RepartitionByExpression" not in plan(few)
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    for out in (co.quantize(few, 8), co.preprocess(few), co.normalize(few)):
        assert "shuffle_hash" in plan(out)


def test_live_samples_are_written_by_several_tasks(spark, small, monkeypatch):
    """A micro-batch has as many files as its samples fill, and the stream's decisions don't depend on them."""
    import duckdb

    from spectrel.functions.tables import shared_folder
    from spectrel.plans import fixtures
    from spectrel.plans.registry import ORACLE

    monkeypatch.setattr(fixtures, "LINES", 2000)
    got = {(r.group_id, r.stop, r.score, r.visible, r.changed) for r in QUERIES["l_live_evolution"](spark, small).collect()}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{small}/lineitem.parquet'")
    want = {(r[0], r[1], r[2], r[5], r[6]) for r in con.execute(ORACLE["l_live_evolution"]).fetchall()}
    assert got == want and want
    root = shared_folder(spark)
    newest = max((p for p in __import__("pathlib").Path(root.removeprefix("file:")).glob("live-*/samples")), key=lambda p: p.stat().st_mtime)
    assert len(list(newest.glob("turn=0/*.parquet"))) > 1


@pytest.mark.parametrize("name", ["a07_one_line_files", "a08_one_line_files", "g13_one_line_features"])
def test_files_of_one_line_follow_from_the_numbers(spark, small, monkeypatch, name):
    """Series are written to as many files as their numbers fill, not to a file and a folder a record; pieces and ranges cut through records."""
    from pathlib import Path

    import duckdb

    from spectrel.functions.tables import shared_folder
    from spectrel.plans import fixtures
    from spectrel.plans.registry import ORACLE
    from spectrel.sources import longtext

    monkeypatch.setattr(fixtures, "LINES", 2000)
    monkeypatch.setattr(longtext, "PIECE", 100)
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.glob("*/**/*.txt"))
    got = sorted(map(tuple, QUERIES[name](spark, small).collect()))
    assert len(set(root.glob("*/**/*.txt")) - before) <= 4 < fixtures.manifest(spark, small).count()
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{small}/lineitem.parquet'")
    assert got == sorted(con.execute(ORACLE[name]).fetchall()) and got


def test_numbers_without_a_record_are_an_error(spark):
    from spectrel.sources import longtext

    blocks = spark.createDataFrame([(0, 0, [float(i) for i in range(7)]), (0, 7, [7.0, 8.0]), (1, 0, [9.0])], "file int, start long, x array<double>")
    index = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 1, 0), ("c", 0, 1, 6), ("d", 0, 7, 2), ("e", 1, 0, 1)], "k string, file int, first long, size long")
    for piece in (1, 2, 3, 5, 100):
        got = sorted(map(tuple, longtext.record_samples(blocks, index, piece).collect()))
        assert got == [("a", 0, 0.0), *[("c", i, 1.0 + i) for i in range(6)], ("d", 0, 7.0), ("d", 1, 8.0), ("e", 0, 9.0)]
        with pytest.raises(Exception, match="differ in length"):
            longtext.record_samples(blocks, index.where("k <> 'd'"), piece).collect()
        with pytest.raises(Exception, match="differ in length"):
            longtext.record_samples(blocks.where("file = 0"), index, piece).collect()


def test_softmax_fits_end(spark, monkeypatch):
    """A fit of three classes is done after some passes over its rows: rounding errors in the sum of the intercepts kept it going for all 50 steps."""
    import numpy as np

    from spectrel.operators import learning as le

    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        x = rng.standard_normal((200, 3)) * [1, 10, 0.1] + [g % 3, 5 * (g % 2), 1000]
        rows += [(f"g{g}", "LH"[i % 2], "abc"[g % 3], *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "group_id string, part string, label string, u double, v double, w double")
    passes, summed = [], le._summed
    monkeypatch.setattr(le, "_summed", lambda *a: passes.append(1) or summed(*a))
    fits = le.fit_final(df, ["u", "v", "w"], "label")
    assert len(passes) <= 20
    # the gradient of the loss as it is told: balanced classes, z-scores, L2 with C = 1
    x, y = np.array([r[3:] for r in rows]), np.array(["abc".index(r[2]) for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    prob = fits.probabilities(x, 0)
    w = (len(y) / (3 * np.bincount(y)))[y]
    off = ((prob - np.eye(3)[y]) * w[:, None]).T
    assert np.abs(off @ z + fits.coef[0] * x.std(0)).max() < 1e-5 and np.abs(off.sum(1)).max() < 1e-5
    assert abs((fits.intercept[0] + fits.coef[0] @ x.mean(0)).sum()) < 1e-6


def test_calibration_makes_its_features_once(spark, monkeypatch):
    """Which partitions there are is asked of stored features: it made all of them before, once more."""
    from spectrel.operators import bundle as bu

    class Stop(Exception):
        pass

    def asked(features):
        assert "mapInArrow" not in plan(features) and "MapInArrow" not in plan(features)
        raise Stop

    monkeypatch.setattr(bu, "check_partitions", asked)
    rows = spark.range(4).mapInArrow(lambda b: b, "id long")
    with pytest.raises(Stop):
        bu.calibrate(rows)


def test_noise_is_made_once_for_all_levels(spark, small):
    """A window's noise of a repetition is hashed before it is copied for the five levels; it was hashed for each of them."""
    import duckdb

    from spectrel.plans import audits as au
    from spectrel.plans.registry import ORACLE

    text = plan(au.noise_grid(au.emb_arrays(spark, small), au.LEVELS, au.REPEATS)).splitlines()
    assert min(i for i, s in enumerate(text) if "md5" in s) > max(i for i, s in enumerate(text) if "Generate explode" in s)
    got = {r[0]: r[1:] for r in map(tuple, QUERIES["j05_noise_sensitivity"](spark, small).collect())}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    want = {r[0]: r[1:] for r in con.execute(ORACLE["j05_noise_sensitivity"]).fetchall()}
    assert got.keys() == want.keys() and all(a == pytest.approx(b, abs=1e-8) if a is not None and b is not None else a == b for k in got for a, b in zip(got[k], want[k], strict=True))


def test_table_functions_look_columns_up_once_a_part():
    """Names of columns are searched once a part, not for every sample and column."""
    from spectrel.functions import udtfs

    class Placed(tuple):
        __fields__ = ["part", "n", "label", "x"]

        def __getitem__(self, i):
            assert not isinstance(i, str)
            return tuple.__getitem__(self, i)

    rows = [Placed(("L", n, "a", n / 2)) for n in range(7)]
    f = udtfs.Frames()
    assert [t for r in rows for t in f.eval(r, 3, 2)] == [("L", "a", i, 2 * i + m, m, (2 * i + m) / 2) for i in range(3) for m in range(3)]
    p = udtfs.perturbation(lambda x, k: x * k)()
    for r in rows:
        p.eval(r, 4)
    assert list(p.terminate()) == [("L", "a", n, 2.0 * n) for n in range(7)]


@pytest.mark.parametrize("name", ["g03_record_fft", "g04_record_psd"])
def test_short_records_are_transformed_many_a_call_and_numbered_once(spark, small, name):
    """Python was called for every block of a record; the samples were numbered for the lengths, for the transform and for that of odd lengths, and sorted in joins."""
    text = plan(QUERIES[name](spark, small))
    assert "MapInArrow" in text and "FlatMapGroups" not in text
    assert "Window" not in text and "LeftSemi" not in text and "strategy=shuffle_hash" in text


def test_whole_records_by_more_tasks(spark, monkeypatch):
    """Tasks follow from the records' numbers; blocks that go over several of Python's batches, and samples in any order, give NumPy's transform."""
    import numpy as np
    from pyspark.sql import functions as F

    from spectrel.operators import longfft as lf

    rng = np.random.default_rng(14)
    records = {f"g{i}": rng.standard_normal(n) for i, n in enumerate([7, 8, 33, 36, 37, 64, 97, 128, 36, 97])}
    s = spark.createDataFrame([(g, "L", i, float(v)) for g, x in records.items() for i, v in enumerate(x)], "group_id string, part string, n long, x double").cache()
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(most)
    monkeypatch.setattr(lf, "NUMBERS", 32)
    try:
        for rows, order in (("3", F.rand(1)), ("5", F.col("n")), ("10000", F.col("group_id"))):
            spark.conf.set(most, rows)
            out = lf.record_fft(s.orderBy(order), block=32, largest=16)
            assert out.rdd.getNumPartitions() > 4
            got = out.orderBy("group_id", "k").toPandas()
            for g, x in records.items():
                one = got[got.group_id == g]
                assert one.k.tolist() == list(range(len(x))) and np.abs(one.re.to_numpy() + 1j * one.im.to_numpy() - np.fft.fft(x)).max() < 1e-9
    finally:
        spark.conf.set(most, was)


def test_records_too_short_are_left_out_by_their_row(spark):
    from spectrel.operators import longfft as lf

    s = spark.createDataFrame([(g, "L", i, float(i * i % 5)) for g, n in (("a", 7), ("b", 8), ("c", 9)) for i in range(n)], "group_id string, part string, n long, x double")
    got = lf.record_spectrum(s, 64.0, "hamming", "constant", True, least=8)
    assert {(r.group_id, r["count"]) for r in got.groupBy("group_id").count().collect()} == {("b", 5), ("c", 5)}


@pytest.mark.parametrize("piece", [1 << 14, 100])
def test_packed_windows_are_those_of_the_long_form(spark, small, monkeypatch, piece):
    """Recordings are packed once where their lines are sorted; windows of records in one piece or several, that go over Python's batches, have the features of the long form."""
    import numpy as np

    from spectrel.operators import packed
    from spectrel.plans import audits as au

    monkeypatch.setattr(packed, "PIECE", piece)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(most)
    try:
        spark.conf.set(most, "37" if piece == 100 else was)
        for config in (au.CONFIG20, au.FeatureConfig(32, 16, 5, 20, 32, "hamming", au.FS)):
            got = au.planted_features(spark, small, config, partitions=("dev", "eval"))
            got = got.toPandas().sort_values("window_id").reset_index(drop=True)
            want = au.planted_features(spark, small, config, lambda s: s).where("partition <> 'holdout'").toPandas().sort_values("window_id").reset_index(drop=True)
            assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
            for c in got.columns:
                assert np.allclose(got[c], want[c], atol=1e-9) if got[c].dtype == float else (got[c] == want[c]).all()
    finally:
        spark.conf.set(most, was)


def test_configurations_are_fitted_together(spark, monkeypatch):
    """Several tables of features take as many passes as one; their figures are those of each alone, also where a table lacks groups."""
    import numpy as np

    from spectrel.operators import bundle as bu
    from spectrel.operators import learning as le

    rng = np.random.default_rng(4)
    columns, places, _ = bu.variant_places(20)
    stages, rows, facts = le.STAGES[:2], [], []
    for g in range(48):
        model = ("none", "bebop", "ar", "phantom")[g % 4]
        facts.append((f"g{g}", "target" if g % 4 else "background", model, "x"))
        for t in range(2):
            for part in "LH":
                x = rng.standard_normal((5 + g % 3, len(columns))) + 0.4 * (t + 1) * (g % 4)
                rows.append((t, f"g{g}", part, 1, len(x), x.reshape(-1).tolist()))
    packed = spark.createDataFrame(rows, "t_ int, group_id string, part string, blocks_ int, n_ int, x_ array<double>").cache()
    facts = spark.createDataFrame(facts, "group_id string, activity string, model string, mode string")
    passes, summed = [], le._summed
    monkeypatch.setattr(le, "_summed", lambda *a: passes.append(1) or summed(*a))
    figures = lambda p, n: {(r.table, r.band_count): (r["mean"], r.dispersion) for r in bu.compare_tables(p, facts, n, columns, places, stages).collect()}
    both = figures(packed, 2)
    assert len(passes) <= 20
    alone = [figures(packed.where(f"t_ = {t}").withColumn("t_", packed.t_ * 0), 1) for t in range(2)]
    assert both == {(t, n): v for t in range(2) for (_, n), v in alone[t].items()} and len(both) == 6
    fewer = figures(packed.where("t_ = 0 or group_id <> 'g5'"), 2)
    assert {k: v for k, v in fewer.items() if k[0] == 0} == {(0, n): v for (_, n), v in alone[0].items()} and len(fewer) == 6

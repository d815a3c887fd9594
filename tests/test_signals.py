"""Known values, conservation, agreement of relational and Arrow forms, filters and learning against independent solutions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectrel.functions import windows as W
from spectrel.operators import conditioning as co
from spectrel.operators import decision as de
from spectrel.operators import features as feat
from spectrel.operators import filters as fi
from spectrel.operators import framing as fr
from spectrel.operators import kernels, robust
from spectrel.operators import learning as le
from spectrel.plans.spectral_queries import features4 as features_of
from spectrel.operators import spectral as sp
from spectrel.operators import synth as sy
from spectrel.plans.fixtures import FS, SIZE, emb_arrays, emb_windows, series_user


def test_window_metrics(spark):
    got = {r.name: r for r in W.window_metrics(W.window_table(spark, ["rectangular", "hann", "hamming", "blackman"], 1024), 1024, 40e6).collect()}
    for name, gain, enbw in (("boxcar", 1, 1), ("hann", 0.5, 1.5), ("hamming", 0.54, 1.36282578), ("blackman", 0.42, 1.72675736)):
        assert got[name].coherent_gain == pytest.approx(gain, abs=1e-9) and got[name].enbw_bins == pytest.approx(enbw, abs=1e-7)
    with pytest.raises(ValueError):
        W.window_name("kaiser")


def test_quantiser(spark):
    base = sy.time_axis(spark, 2000, 2000.0).select("n", sy.tone(F.col("t"), 180).alias("x"))
    for bits, mse in ((3, 5.89999638e-3), (4, 1.37905197e-3), (8, 5.03779708e-6), (12, 1.17689388e-8)):
        e = co.quantize(base, bits, keys=()).select((F.col("x") - F.col("xq")).alias("e")).agg(F.avg(F.col("e") * F.col("e")), F.max(F.abs("e"))).first()
        assert e[0] == pytest.approx(mse, rel=1e-6) and e[1] <= 1 / (2**bits - 1) + 1e-12


def test_fir_and_iir_design():
    band = [9.259765625e6, 10.759765625e6]
    fir = fi.design_fir("bandpass", 40e6, band, 401)
    b, a = fi.design_iir("passband", 40e6, band, 4)
    at = lambda b, a, hz: 20 * math.log10(abs(fi.at_z(b, a, np.exp(2j * math.pi * hz / 40e6))) + 1e-300)
    centre = sum(band) / 2
    assert abs(at(fir, [1.0], centre)) < 0.05 and abs(at(b, a, centre)) < 0.05
    assert at(b, a, band[0]) == pytest.approx(-3.0103, abs=1e-3) and at(b, a, band[1]) == pytest.approx(-3.0103, abs=1e-3)
    assert at(fir, [1.0], 8e6) < -50 and at(b, a, 8e6) < -30
    z, p = fi.zeros_and_poles(b, a)
    assert len(z) == len(p) == 8 and max(abs(p)) == pytest.approx(0.9562081109, abs=1e-8) and fi.is_stable(a) and not fi.is_stable([1.0, -1.5])
    assert len(fi.zeros_and_poles(fir, [1.0])[0]) == 400
    assert fi.expression([1.0, 0.0, -0.5], [1.0]) == "H(z) = (1 - 0.5 z^-2) / (1)"
    for kind in ("low", "high", "bandstop"):
        b, a = fi.design_iir(kind, 100.0, [20.0, 30.0] if kind == "bandstop" else 20.0, 3)
        assert abs(fi.at_z(b, a, 1.0 if kind != "high" else -1.0)) == pytest.approx(1, abs=1e-9) and fi.is_stable(a)
    assert fi.is_stable(fi.design_iir("low", 100.0, 20.0, 4, "bessel")[1])
    with pytest.raises(ValueError):
        fi.design_iir("low", 100.0, 20.0, 4, "ellip")


def test_zero_phase_keeps_a_tone_in_place(spark):
    x = np.sin(2 * np.pi * 3 * np.arange(400) / 100)
    b, a = fi.design_iir("low", 100.0, 10.0, 4)
    y = fi.filtfilt(b, a, x)
    assert np.abs(y - x).max() < 0.01
    recs = spark.createDataFrame([("g", "L", x.tolist())], "group_id string, part string, x array<double>")
    assert np.allclose(fi.apply_filter(recs, b, a).first().y, y)
    h = fi.lfilter(b, a, np.r_[1.0, np.zeros(200)])
    assert abs(h.sum() - b.sum() / a.sum()) < 1e-9


def test_relational_and_kernel_features_agree(spark, small):
    rel = feat.feature_table(emb_windows(spark, small), FS, SIZE, 4, 32, "hann", ("window_id",), 16).orderBy("window_id").toPandas()
    ker = kernels.feature_table(emb_arrays(spark, small), FS, 4, 32, "hann", "win", 16).orderBy("window_id").toPandas()
    for c in (*feat.BASE_FEATURES, *feat.band_columns(4, False), *feat.band_columns(4)):
        assert np.allclose(rel[c], ker[c], rtol=0, atol=1e-9), c
    # bands tile the spectrum: their powers add up to the whole
    assert np.allclose(ker[feat.band_columns(4, False)].sum(axis=1), ker.psd_total_power) and np.allclose(ker[feat.band_columns(4)].sum(axis=1), 1)


def test_known_tone(spark):
    w = sy.time_axis(spark, 1024, 1024.0).select(F.lit(1).alias("window_id"), "n", sy.tone(F.col("t"), 180.0, 2.0).alias("x"))
    top = sp.peak(sp.fft_magnitude(w, 1024.0, 1024, window="hann", keys=("window_id",)), "magnitude", ("window_id",)).first()
    assert top.peak_hz == 180.0 and top.peak == pytest.approx(2.0, abs=1e-9)
    power = sp.psd_power(sp.welch(w, 1024.0, 1024, 256, keys=("window_id",)), ("window_id",)).first().power
    assert power == pytest.approx(2.0, rel=0.02)


def test_frames(spark):
    s = spark.range(10).select(F.lit("g").alias("group_id"), F.lit("L").alias("part"), F.lit("t").alias("label"), F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
    assert [(r.start, r.stop) for r in fr.frame_table(s, 4, 3).orderBy("idx").collect()] == [(0, 4), (3, 7), (6, 10)]
    assert [(r.start, r.stop) for r in fr.frame_table(s, 4, 4, drop_last=False).orderBy("idx").collect()] == [(0, 4), (4, 8), (6, 10)]
    assert [(r.start, r.stop) for r in fr.frame_table(s, 16, 4, drop_last=False).collect()] == [(0, 10)] and fr.frame_table(s, 16).count() == 0
    arrays = fr.frame_arrays(co.records(s), 4, 3).orderBy("idx").collect()
    assert [r.win for r in arrays] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]


def test_linspace_starts(spark):
    for c in (101, 250, 999):
        f = spark.range(c).select(F.lit("g").alias("group_id"), F.lit("L").alias("part"), F.col("id").alias("idx"))
        got = sorted(r.idx for r in fr.deterministic_starts(f, 100).collect())
        assert got == np.linspace(0, c - 1, 100).astype(int).tolist()


def test_preprocess_rejects_what_is_not_finite(spark):
    s = spark.createDataFrame([("g", "L", 0, float("nan"))], "group_id string, part string, n long, x double")
    with pytest.raises(Exception, match="finite"):
        co.preprocess(s).collect()


scores = st.lists(st.tuples(st.sampled_from([0.1, 0.25, 0.5, 0.55, 0.8, 0.333]), st.booleans()), min_size=4, max_size=20).filter(lambda v: len({b for _, b in v}) == 2)


@settings(max_examples=5, deadline=None)
@given(scores)
def test_threshold_by_hand(spark, values):
    df = spark.createDataFrame([(s, "target" if t else "background") for s, t in values], "score double, label string")
    got = de.choose_threshold(df).first()

    def ba(t):
        side = lambda k: np.mean([(s >= t) == k for s, b in values if b == k])
        return round((side(True) + side(False)) / 2, 12)

    grid = sorted({0.5, *[round(v, 9) for v in np.linspace(0.05, 0.95, 181)], *[s for s, _ in values]})
    best = max(grid, key=lambda t: (ba(t), -round(abs(t - 0.5), 9), -t))
    assert (got.threshold, got.balanced_accuracy) == (best, ba(best))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["a", "b"]), st.sampled_from([0.0, 0.01, 0.2, 0.45, 0.7])), min_size=3, max_size=15))
def test_rejection_by_hand(spark, values):
    df = spark.createDataFrame(values, "label string, prediction string, margin double")
    choices = []
    for t in sorted({round(v, 9) for v in np.linspace(0, 0.5, 101)} | {m for _, _, m in values}):
        lost = np.array([m < t for _, _, m in values])
        if lost.mean() <= 0.30:
            risk = [np.mean([(0.25 if x else float(p != c)) for (k, p, _), x in zip(values, lost, strict=True) if k == c]) for c in {k for k, _, _ in values}]
            choices.append((round(float(np.mean(risk)), 12), t))
    got = de.choose_rejection(df).first()
    assert (got.risk, got.rejection_margin) == min(choices)


def test_report_counts_inconclusive_as_a_class(spark):
    df = spark.createDataFrame([("target", "target"), ("target", "inconclusive"), ("background", "background"), ("background", "background")], "label string, visible string")
    r = de.report(df).first()
    assert r.accuracy == 0.75 and r.balanced_accuracy == 0.75 and r.recall_macro == pytest.approx(0.5) and r.precision_macro == pytest.approx(2 / 3)


def newton(x, y, w, c=1.0):
    """Binary logistic regression with a free intercept: sum of weighted losses + |beta|^2 / 2c."""
    a = np.c_[np.ones(len(x)), x]
    beta, ridge = np.zeros(a.shape[1]), np.r_[0, np.ones(x.shape[1])] / c
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        g = a.T @ (w * (p - y)) + ridge * beta
        beta -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(ridge), g)
    return 1 / (1 + np.exp(-a @ beta))


def test_linear_model_solves_the_stated_problem(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.standard_normal(120) > 1.5).astype(int)
    df = spark.createDataFrame([(*map(float, v), "target" if t else "background") for v, t in zip(x, y, strict=True)], "f double, g double, h double, label string").coalesce(1)
    got = le.fit_linear(df, ["f", "g", "h"], "label", tol=1e-10).score(df).toPandas()
    w = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    assert np.allclose(got.score__target, newton((x - x.mean(0)) / x.std(0), y, w), atol=1e-5)


def test_folds_and_splits(spark, small):
    rows = series_user(spark, small).select("group_id", "label").distinct()
    folds = le.group_folds(rows, "label", 5)
    assert folds.count() == rows.count() == folds.select("group_id").distinct().count()
    sizes = folds.groupBy("label", "fold").count().toPandas().groupby("label")["count"]
    assert (sizes.max() - sizes.min() <= 1).all()
    split = le.train_test_groups(rows, "label", 0.25)
    assert split.where("test").select("label").distinct().count() == split.where("not test").select("label").distinct().count() == 2
    with pytest.raises(ValueError, match="both sides"):
        le.assert_no_leak(rows, rows.limit(3))
    assert le.choose_splits(rows, "label", 10) == (5, True)
    assert rows.join(le.permuted_labels(rows, "label", 3).withColumnRenamed("label", "new"), "group_id").where("label <> new").count() > 0


def test_out_of_fold_scores(spark, small):
    x = kernels.feature_table(emb_arrays(spark, small), FS, 4, 32, "hann", "win", 16).coalesce(1).cache()
    out = le.out_of_fold(x, ["crest_factor", "peak"], "label", 2).toPandas()
    assert len(out) == x.select("group_id").distinct().count() and out.group_id.is_unique and out[["score__target", "score__background"]].sum(axis=1).between(0.5, 1.5).all()


def newton_table(rows, columns, label):
    x = rows[columns].to_numpy()
    y = (rows[label] == "target").to_numpy().astype(int)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    return x, y, w


def test_fitted_together_as_alone(spark, small):
    """Out-of-fold scores of all folds against a Newton solution of each, and softmax against Spark ML."""
    rows = kernels.feature_table(emb_arrays(spark, small), FS, 4, 32, "hann", "win", 16)
    columns = ["crest_factor", "peak", "spectral_centroid_hz"]
    got = le.out_of_fold(rows, columns, "label", 3).toPandas().set_index("group_id")
    table = rows.toPandas()
    fold = {r.group_id: r.fold for r in le.group_folds(rows, "label", 3).collect()}
    table["fold"] = table.group_id.map(fold)
    for f in range(3):
        train, test = table[table.fold != f], table[table.fold == f]
        x, y, w = newton_table(train, columns, "label")
        centre, scale = x.mean(0), x.std(0)
        a = np.c_[np.ones(len(x)), (x - centre) / scale]
        beta = np.zeros(a.shape[1])
        ridge = np.r_[0, np.ones(len(columns))]
        for _ in range(60):
            p = 1 / (1 + np.exp(-a @ beta))
            beta -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (w * (p - y)) + ridge * beta)
        test = test.assign(s=1 / (1 + np.exp(-np.c_[np.ones(len(test)), (test[columns].to_numpy() - centre) / scale] @ beta)))
        want = test.groupby(["group_id", "part"]).s.median().groupby("group_id").mean()
        assert np.allclose(got.loc[want.index, "score__target"], want, atol=1e-8)
    three = rows.withColumn("cls", F.concat(F.lit("k"), F.pmod(F.substring("group_id", 3, 1).cast("int"), F.lit(3)).cast("string")))
    a = le.model_scores(three, le.fit_final(three, columns, "cls").as_dict()).select("window_id", "score__k0", "score__k1").orderBy("window_id").toPandas()
    b = le.fit_linear(three, columns, "cls", tol=1e-10).score(three).select("window_id", "score__k0", "score__k1").orderBy("window_id").toPandas()
    assert np.allclose(a[["score__k0", "score__k1"]], b[["score__k0", "score__k1"]], atol=1e-5)


def test_nested_and_permuted(spark, small):
    rows = kernels.feature_table(emb_arrays(spark, small), FS, 4, 32, "hann", "win", 16)
    decided, trace = le.nested_binary(rows, ["crest_factor", "peak"], "label", 3, 2, 42, 2)
    out, trace = decided.toPandas(), trace.toPandas()
    groups = rows.select("group_id").distinct().count()
    assert len(out) == 2 * groups and out.groupby(["repeat", "fold"]).threshold.nunique().eq(1).all()
    for _, one in trace.groupby(["repeat", "fold"]):
        role = {k: set(v.group_id) for k, v in one.groupby("role")}
        assert not role["test"] & (role["train"] | role["threshold"]) and role["train"] == role["threshold"] and len(role["test"] | role["train"]) == groups
    p = le.permutation_scores(rows, ["crest_factor", "peak"], "label", range(6), 3)
    assert p.count() == 6 and p.select("balanced_accuracy").distinct().count() > 1
    observed = spark.createDataFrame([(0.9,)], "observed double")
    found = de.p_values(p, observed).first()
    assert found.permutations == 6 and found.p_value == pytest.approx(1 / 7)
    cv = le.cross_validation(rows, ["crest_factor", "peak"], "label", 5).toPandas()
    assert sorted(cv.fold) == [-1, 0, 1, 2, 3, 4] and cv[cv.fold >= 0].n_test.sum() == groups
    with pytest.raises(ValueError, match="two classes"):
        le.fit_final(rows.where("label = 'target'"), ["peak"], "label")


def test_relational_and_fft_spectra_agree(spark, small):
    w, a, k = emb_windows(spark, small), emb_arrays(spark, small), ("window_id",)
    pairs = [
        (sp.fft_magnitude(w, FS, SIZE, window="hann", keys=k), kernels.fft_table(a, FS, window="hann"), "magnitude"),
        (sp.fft_magnitude(w, FS, SIZE, n_fft=128, detrend=True, keys=k), kernels.fft_table(a, FS, n_fft=128, detrend=True), "magnitude"),
        (sp.fft_magnitude(w, FS, SIZE, n_fft=32, window="hamming", keys=k), kernels.fft_table(a, FS, n_fft=32, window="hamming"), "magnitude"),
        (sp.periodogram(w, FS, SIZE, keys=k), kernels.periodogram_table(a, FS), "psd"),
        (sp.welch(w, FS, SIZE, 32, 20, "blackman", k), kernels.welch_table(a, FS, 32, 20, "blackman"), "psd"),
        (sp.blackman_tukey(w, FS, SIZE, keys=k), kernels.blackman_tukey_table(a, FS), "psd"),
        (sp.blackman_tukey(w, FS, SIZE, compat=True, keys=k), kernels.blackman_tukey_table(a, FS, compat=True), "psd"),
    ]
    for rel, fft, value in pairs:
        x, y = (t.orderBy("window_id", "k").toPandas() for t in (rel, fft))
        assert len(x) == len(y) and np.allclose(x[value], y[value], rtol=0, atol=1e-9) and np.allclose(x.freq_hz, y.freq_hz)


def test_two_sided_spectrum_of_a_rotation():
    x = np.exp(2j * np.pi * -5 * np.arange(64) / 64)[None]
    freqs, magnitude = kernels.fft_batch(x, 64.0)
    assert freqs[0] == -32 and freqs[magnitude[0].argmax()] == -5 and magnitude.max() == pytest.approx(1)
    freqs, psd = kernels.welch_batch(x + 0.0, 64.0, 32, 16)
    assert freqs[psd[0].argmax()] in (-6.0, -4.0) and (np.diff(freqs) > 0).all()


@pytest.mark.parametrize("length,block", [(500, 64), (130, 64), (64, 64), (10, 64), (3, 64), (1, 64)])
def test_filters_in_blocks(spark, length, block):
    rng = np.random.default_rng(length)
    x = {(g, p): rng.standard_normal(length) for g in ("a", "b") for p in "LH"}
    s = spark.createDataFrame([(g, p, i, float(v)) for (g, p), xs in x.items() for i, v in enumerate(xs)], "group_id string, part string, n long, x double").repartition(5)
    b, a = fi.design_iir("bandpass", 100.0, [10.0, 20.0], 3)
    taps = fi.design_fir("low", 100.0, 10.0, 21)

    def plain(b, a, x):
        d, out = np.zeros(len(a)), []
        for v in x:
            y = b[0] * v + d[0]
            d[:-1] = d[1:] + b[1:] * v - a[1:] * y
            out.append(y)
        return np.array(out)

    for name, df, of in (("fir", fi.apply_fir(s, taps, block=block), lambda v: np.convolve(v, taps)[: len(v)]), ("causal", fi.apply_iir(s, b, a, False, block=block), lambda v: plain(b, a, v)), ("both", fi.apply_iir(s, b, a, block=block), lambda v: fi.filtfilt(b, a, v))):
        got = df.orderBy("group_id", "part", "n").toPandas()
        assert len(got) == 4 * length
        for (g, p), v in x.items():
            assert np.allclose(got[(got.group_id == g) & (got.part == p)].y, of(v), atol=1e-8), name


def test_filter_names():
    for name, kind in (("stopband", "bandstop"), ("notch", "bandstop"), ("passband", "bandpass"), ("low", "lowpass"), ("highpass", "highpass")):
        assert fi.kind_of(name) == kind


@pytest.mark.parametrize("cell", [2, 5, 4096])
def test_exact_medians(spark, cell):
    rng = np.random.default_rng(3)
    values = [(k, float(v), float(w)) for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)) for v, w in zip(rng.standard_normal(n).round(1), rng.integers(0, 3, n), strict=True)]
    df = spark.createDataFrame(values, "k string, v double, w double").repartition(4)
    got = {r.k: (r.v, r.w) for r in robust.exact_medians(df, ["k"], ["v", "w"], cell=cell).collect()}
    assert got == {k: tuple(np.median([[v, w] for q, v, w in values if q == k], axis=0)) for k in "abcd"}


def test_sampled_windows_are_those_of_all_frames(spark):
    for length in (10, 32, 100, 333, 340):
        s = spark.range(length).select(F.lit("g").alias("group_id"), F.lit("L").alias("part"), F.lit("t").alias("label"), F.col("id").alias("n"), F.col("id").cast("double").alias("x"))
        frames = fr.deterministic_starts(fr.frame_table(s, 16, 4), 9)
        want = sorted((r.idx, r.start) for r in frames.collect())
        got = fr.sampled_windows(s, 16, 4, 9).orderBy("number").collect()
        assert [(r.idx, r.start) for r in got] == want and [r.number for r in got] == list(range(len(want))) and all(r.win == list(range(r.start, r.stop)) for r in got)


def test_impulses_and_ranks(spark):
    s = spark.range(3000).select(F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("group_id"), F.lit("L").alias("part"), F.floor(F.col("id") / 2).alias("n"), F.lit(1.0).alias("x"))
    hit = sy.add_impulses(s, 0.01, 5.0, 3).where("x <> 1").groupBy("group_id").count().collect()
    assert [r["count"] for r in hit] == [15, 15]
    ranked = le.hash_rank(s.select("group_id", F.concat("group_id", F.lit(":"), F.col("n").cast("string")).alias("id")), le.hash_order(1, "id"), "r", ["group_id"], "id").toPandas()
    assert all(sorted(g.r) == list(range(1, 1501)) for _, g in ranked.groupby("group_id"))


def test_guards(spark):
    rows = spark.createDataFrame([(f"g{i}", p, 1.0 + 0.1 * i, 2.0 * i) for i in range(6) for p in "LH"], "group_id string, part string, crest_factor double, f double")
    vectors = robust.group_vectors(rows, ["crest_factor", "f"])
    params, limit = robust.calibrate_domain(vectors, ["crest_factor", "f"])
    assert robust.check_domain(vectors, params, limit, ["crest_factor", "f"]).where("not in_domain").count() == 0
    far = spark.createDataFrame([("x", 99.0, 99.0)], "group_id string, crest_factor double, f double")
    assert not robust.check_domain(far, params, limit, ["crest_factor", "f"]).first().in_domain
    with pytest.raises(Exception, match="more than one label"):
        robust.group_scores(rows.withColumn("label", F.col("part")), ["f"]).collect()


def test_config():
    assert feat.FeatureConfig().validate().band_count == 20
    for bad in ({"band_count": 7}, {"nperseg": 2048}, {"window": "rect"}, {"hop_size": 0}):
        with pytest.raises(ValueError):
            feat.FeatureConfig(**bad).validate()


@pytest.mark.parametrize("rows", [7, 4096])
def test_blocks_of_rows(spark, small, monkeypatch, rows):
    """However rows are packed, scores are the same; a group's uses are held once a block."""
    x = features_of(spark, small)
    want = le.out_of_fold(x, ["crest_factor", "peak"], "label", 3).toPandas().sort_values("group_id")
    monkeypatch.setattr(le, "BLOCK_ROWS", rows)
    got = le.out_of_fold(x, ["crest_factor", "peak"], "label", 3).toPandas().sort_values("group_id")
    assert list(got.group_id) == list(want.group_id) and np.allclose(got.score__target, want.score__target, atol=1e-9) and (got.parts_used.to_numpy() == want.parts_used.to_numpy()).all()
    groups = x.groupBy("group_id").agg(F.array(F.lit(0), F.lit(-1)).alias("y_"), F.array().cast("array<struct<run:int,model:int,fold:int,label:string>>").alias("tests_"))
    blocks = le.deal(x, ["crest_factor", "peak"], groups)
    assert blocks.agg(F.sum("n_")).first()[0] == x.count() and blocks.where("size(x_) <> 2 * n_ or size(y_) <> 2").count() == 0
    assert blocks.groupBy("group_id", "part").agg((F.count("*") > F.max("blocks_")).alias("more")).where("more").count() == 0

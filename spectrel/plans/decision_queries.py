"""Queries of robust aggregation, guards, calibration and decisions, on scores of a frozen linear model over the features of embeddings' windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrel.functions.tables import stored
from spectrel.operators import decision as de
from spectrel.operators import robust
from spectrel.plans.registry import query
from spectrel.plans.spectral_queries import FEATURE_CTES, features4, rounded

#: The frozen models: activity, and model among three classes.
ACTIVITY = {"target": {"rel_band_power_1": 3.0, "rel_band_power_4": -2.0, "crest_factor": 0.8, "intercept": -2.3}}
MODEL = {"a": {"rel_band_power_1": 4.0, "intercept": -1.0}, "b": {"rel_band_power_2": 4.0, "intercept": -1.0}, "c": {"crest_factor": 0.5, "intercept": -1.2}}
MODE = {"m1": {"rel_band_power_3": 3.0}, "m2": {"rel_band_power_4": 3.0}}
THRESHOLD, REJECTION = 0.5, 0.02
GUARD = ("rms", "crest_factor", "spectral_centroid_hz", "spectral_bandwidth_hz", "rel_band_power_1", "rel_band_power_4")


def linear(w: dict) -> str:
    return "(" + " + ".join(f"{v}::DOUBLE" if c == "intercept" else f"{v}::DOUBLE * {c}" for c, v in w.items()) + ")"


def soft(models: dict, name: str) -> str:
    return f"exp({linear(models[name])}) / ({' + '.join(f'exp({linear(w)})' for w in models.values())})"


TRUE_MODEL = "CASE CAST(substr(group_id, length(group_id), 1) AS INTEGER) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"
SCORE_COLUMNS = {"s_act": f"1 / (1 + exp(-{linear(ACTIVITY['target'])}))", **{f"s_{c}": soft(MODEL, c) for c in MODEL}, **{f"s_{c}": soft(MODE, c) for c in MODE}}
#: gs: group_id, label, truth (of the model stage), fold, parts and the scores of all stages, rounded.
GROUP_CTES = FEATURE_CTES + f""",
ws AS (SELECT group_id, part, label, {', '.join(f'{v} AS {k}' for k, v in SCORE_COLUMNS.items())} FROM ft),
gp AS (SELECT group_id, part, min(label) AS label, {', '.join(f'median({k}) AS {k}' for k in SCORE_COLUMNS)} FROM ws GROUP BY group_id, part),
gs AS MATERIALIZED (SELECT group_id, min(label) AS label, {TRUE_MODEL} AS truth, CAST(substr(group_id, length(group_id), 1) AS INTEGER) % 5 AS fold, CAST(count(DISTINCT part) AS BIGINT) AS parts_used, {', '.join(f'round(avg({k}), 9) AS {k}' for k in SCORE_COLUMNS)} FROM gp GROUP BY group_id)"""


def group_scores(spark, d, features=None):
    x = features4(spark, d) if features is None else features
    x = de.linear_scores(x, ACTIVITY).withColumnRenamed("score__target", "s_act")
    x = de.linear_scores(x, MODEL, "s_")
    x = de.linear_scores(x, MODE, "s_")
    out = robust.group_scores(x, list(SCORE_COLUMNS))
    digit = F.substring("group_id", -1, 1).cast("int")
    truth = F.when(digit % 3 == 0, "a").when(digit % 3 == 1, "b").otherwise("c")
    return rounded(out, 9, *SCORE_COLUMNS).withColumn("truth", truth).withColumn("fold", digit % 5)


def binary(spark, d):
    return de.decide_binary(group_scores(spark, d), THRESHOLD, REJECTION, "s_act")


#: bin: the activity stage's decisions.
BIN = GROUP_CTES + f""", bin AS (SELECT *, CASE WHEN s_act >= {THRESHOLD} THEN 'target' ELSE 'background' END AS prediction, abs(s_act - {THRESHOLD}) AS margin, abs(s_act - {THRESHOLD}) < {REJECTION} AS rejected,
  CASE WHEN abs(s_act - {THRESHOLD}) < {REJECTION} THEN 'inconclusive' WHEN s_act >= {THRESHOLD} THEN 'target' ELSE 'background' END AS visible FROM gs)"""
#: top: the model stage's best class and margin.
TOP = GROUP_CTES + """, lg AS (SELECT group_id, truth, fold, unnest(['a', 'b', 'c']) AS c, unnest([s_a, s_b, s_c]) AS s FROM gs),
rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY s DESC, c) AS r FROM lg),
top AS (SELECT group_id, min(truth) AS truth, min(fold) AS fold, min(c) FILTER (WHERE r = 1) AS prediction, max(s) FILTER (WHERE r = 1) - max(s) FILTER (WHERE r = 2) AS margin FROM rk GROUP BY group_id)"""


def top(spark, d):
    return de.top_predictions(group_scores(spark, d), ["s_a", "s_b", "s_c"], "s_")


@query("e01_group_scores", GROUP_CTES + " SELECT group_id, label, parts_used, round(s_act, 6) AS s_act, round(s_a, 6) AS s_a, round(s_b, 6) AS s_b, round(s_c, 6) AS s_c FROM gs")
def e01(spark, d):
    out = group_scores(spark, d).select("group_id", "label", F.col("parts_used").cast("long").alias("parts_used"), "s_act", "s_a", "s_b", "s_c")
    return rounded(out, 6, "s_act", "s_a", "s_b", "s_c")


PM = FEATURE_CTES + f", pm AS (SELECT group_id, part, min(label) AS label, {', '.join(f'median({c}) AS {c}' for c in GUARD)} FROM ft GROUP BY group_id, part), gv AS MATERIALIZED (SELECT group_id, min(label) AS label, {', '.join(f'avg({c}) AS {c}' for c in GUARD)} FROM pm GROUP BY group_id)"
SCALES = ", ".join(f"median({c}) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 1e-12 THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1e-12 END AS s_{c}" for c in GUARD)


@query("e03_robust_scale", PM + f", sc AS (SELECT {SCALES} FROM gv) SELECT {', '.join(f'round(s_{c}, 6) AS {c}' for c in GUARD)} FROM sc")
def e03(spark, d):
    v = robust.group_vectors(features4(spark, d), GUARD)
    return v.agg(*[F.round(robust.robust_scale(c), 6).alias(c) for c in GUARD])


@query("e05_group_medians", FEATURE_CTES + " SELECT group_id, part, round(median(rms), 6) AS rms, round(median(spectral_centroid_hz), 6) AS spectral_centroid_hz FROM ft GROUP BY group_id, part")
def e05(spark, d):
    return rounded(robust.part_medians(features4(spark, d), ["rms", "spectral_centroid_hz"]), 6, "rms", "spectral_centroid_hz")


@query("e06_condition_summary", BIN + " SELECT fold, round(avg(s_act), 6) AS s_act_mean, round(min(s_act), 6) AS s_act_min, round(max(s_act), 6) AS s_act_max, round(avg(margin), 6) AS margin_mean, round(min(margin), 6) AS margin_min, round(max(margin), 6) AS margin_max FROM bin GROUP BY fold")
def e06(spark, d):
    aggs = [F.round(f(c), 6).alias(f"{c}_{n}") for c in ("s_act", "margin") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return binary(spark, d).groupBy("fold").agg(*aggs)


@query("e07_mean_by_level", BIN + " SELECT fold, round(avg(CAST(rejected AS INTEGER)), 6) AS rejected FROM bin GROUP BY fold")
def e07(spark, d):
    return binary(spark, d).groupBy("fold").agg(F.round(F.avg(F.col("rejected").cast("int")), 6).alias("rejected"))


DOMAIN = PM + f", sc AS (SELECT {SCALES} FROM gv WHERE label = 'target'), ds AS (SELECT gv.group_id, gv.label, sqrt(({' + '.join(f'power(({c} - m_{c}) / s_{c}, 2)' for c in GUARD)}) / {len(GUARD)}) AS distance FROM gv, sc), th AS (SELECT greatest(max(distance) * 1.05, 1e-12) AS threshold, count(*) AS n, max(distance) AS top FROM ds WHERE label = 'target')"


def guard_parts(spark, d, features=None):
    feats = stored(features4(spark, d)) if features is None else features
    vectors = robust.group_vectors(feats, GUARD)
    params, limit = robust.calibrate_domain(robust.group_vectors(feats.where("label = 'target'"), GUARD), GUARD)
    return vectors, params, limit


@query("i21_domain_guard", DOMAIN + " SELECT round(threshold, 6) AS threshold, CAST(n AS BIGINT) AS development_groups, round(top, 6) AS development_distance_max FROM th")
def i21(spark, d):
    _, _, limit = guard_parts(spark, d)
    return rounded(limit.select("threshold", "development_groups", "development_distance_max"), 6, "threshold", "development_distance_max")


@query("i22_domain_check", DOMAIN + " SELECT group_id, round(distance, 6) AS distance, round(distance, 9) <= round(threshold, 9) AS in_domain FROM ds, th")
def i22(spark, d):
    vectors, params, limit = guard_parts(spark, d)
    out = robust.check_domain(vectors, params, limit, GUARD)
    return out.select("group_id", F.round("distance", 6).alias("distance"), (F.round("distance", 9) <= F.round("threshold", 9)).alias("in_domain"))


QUALITY = FEATURE_CTES + ", pc AS (SELECT group_id, part, min(label) AS label, median(crest_factor) AS c FROM ft GROUP BY group_id, part), lim AS (SELECT max(c) AS m, count(DISTINCT group_id) AS n, max(c) * 1.05 AS u FROM pc WHERE label = 'target')"


@query("i23_quality_guard", QUALITY + " SELECT round(m, 6) AS development_maximum, CAST(n AS BIGINT) AS development_groups, round(u, 6) AS upper_limit FROM lim")
def i23(spark, d):
    return rounded(robust.calibrate_quality(features4(spark, d).where("label = 'target'")), 6, "development_maximum", "upper_limit")


@query("i23_quality_check", QUALITY + " SELECT group_id, coalesce(string_agg(part, ',' ORDER BY part) FILTER (WHERE c > u), '') AS parts_over, count(*) FILTER (WHERE c > u) = 0 AS accepted FROM pc, lim GROUP BY group_id")
def i23c(spark, d):
    feats = stored(features4(spark, d))
    out = robust.check_quality(feats, robust.calibrate_quality(feats.where("label = 'target'")))
    return out.select("group_id", F.array_join("parts_over", ",").alias("parts_over"), "accepted")


@query("i02_prior_baseline", GROUP_CTES + ", p AS (SELECT count(*) FILTER (WHERE label = 'background') / count(*) AS b, count(*) FILTER (WHERE label = 'target') / count(*) AS t FROM gs) SELECT group_id, b AS score__background, t AS score__target FROM gs, p")
def i02(spark, d):
    g = group_scores(spark, d)
    return de.prior_scores(g, g.select("group_id"))


@query("i03_frozen_scores", FEATURE_CTES + f" SELECT window_id, {', '.join(f'round({v}, 9) AS {k}' for k, v in SCORE_COLUMNS.items())} FROM ft")
def i03(spark, d):
    x = de.linear_scores(features4(spark, d), ACTIVITY).withColumnRenamed("score__target", "s_act")
    x = de.linear_scores(de.linear_scores(x, MODEL, "s_"), MODE, "s_")
    return rounded(x.select("window_id", *SCORE_COLUMNS), 9, *SCORE_COLUMNS)


@query("i09_top_margin", TOP + " SELECT group_id, prediction, round(margin, 6) AS margin FROM top")
def i09(spark, d):
    return rounded(top(spark, d).select("group_id", "prediction", "margin"), 6, "margin")


@query("i10_threshold", GROUP_CTES + """, c AS (SELECT DISTINCT t FROM (SELECT 0.5::DOUBLE AS t UNION ALL SELECT round(0.05 + 0.9 * i / 180, 9) FROM range(181) r(i) UNION ALL SELECT s_act FROM gs)),
b AS (SELECT t, round((avg(CASE WHEN label = 'target' THEN CAST(s_act >= t AS INTEGER) END) + avg(CASE WHEN label = 'background' THEN CAST(s_act < t AS INTEGER) END)) / 2, 12) AS ba FROM c, gs GROUP BY t)
SELECT t AS threshold, round(ba, 9) AS balanced_accuracy FROM b ORDER BY ba DESC, round(abs(t - 0.5), 9), t LIMIT 1""")
def i10(spark, d):
    return rounded(de.choose_threshold(group_scores(spark, d), "s_act"), 9, "balanced_accuracy")


@query("i11_rejection", TOP + """, pm AS (SELECT truth, prediction, round(margin, 9) AS margin FROM top), c AS (SELECT DISTINCT t FROM (SELECT round(0.5 * i / 100::DOUBLE, 9) AS t FROM range(101) r(i) UNION ALL SELECT margin FROM pm)),
k AS (SELECT t, truth, avg(CASE WHEN margin >= t AND prediction <> truth THEN 1.0::DOUBLE ELSE 0 END + 0.25::DOUBLE * CAST(margin < t AS INTEGER)) AS risk, sum(CAST(margin < t AS INTEGER)) AS lost, count(*) AS n FROM c, pm GROUP BY t, truth),
r AS (SELECT t, round(avg(risk), 12) AS risk, sum(lost) / sum(n) AS rate FROM k GROUP BY t) SELECT t AS rejection_margin, round(risk, 9) AS risk FROM r WHERE rate <= 0.30 ORDER BY r.risk, t LIMIT 1""")
def i11(spark, d):
    p = rounded(top(spark, d), 9, "margin")
    return rounded(de.choose_rejection(p, "truth"), 9, "risk")


@query("i12_summary", BIN + " SELECT group_id, visible, round(margin, 6) AS margin, rejected FROM bin")
def i12(spark, d):
    return rounded(binary(spark, d).select("group_id", "visible", "margin", "rejected"), 6, "margin")


def report_sql(ctes: str, table: str, t: str, p: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return ctes + f""", cl AS (SELECT {k}{t} AS c FROM {table} UNION SELECT {k}{p} FROM {table}),
pc AS (SELECT {''.join('cl.' + x.strip() + ', ' for x in keys.split(',') if x)}cl.c, count(*) FILTER (WHERE {t} = cl.c) AS nt, count(*) FILTER (WHERE {p} = cl.c) AS np, count(*) FILTER (WHERE {t} = cl.c AND {p} = cl.c) AS hit FROM cl JOIN {table} x ON {' AND '.join(f'cl.{y.strip()} = x.{y.strip()}' for y in keys.split(',') if y) or 'true'} GROUP BY ALL),
pr AS (SELECT *, CASE WHEN np > 0 THEN hit / np ELSE 0 END AS pr, CASE WHEN nt > 0 THEN hit / nt ELSE 0 END AS rc FROM pc),
rep AS (SELECT {k}sum(hit) / sum(nt) AS accuracy, avg(rc) FILTER (WHERE nt > 0) AS balanced_accuracy, avg(pr) AS precision_macro, avg(rc) AS recall_macro, avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) AS f1_macro, CAST(sum(nt) AS BIGINT) AS n_groups FROM pr{g})"""


METRICS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro")
REP = ", ".join(f"round({m}, 9) AS {m}" for m in METRICS) + ", n_groups"


@query("i14_report", report_sql(BIN, "bin", "label", "visible") + f" SELECT {REP} FROM rep")
def i14(spark, d):
    return rounded(de.report(binary(spark, d)), 9, *METRICS)


@query("i14_report_model", report_sql(TOP, "top", "truth", "prediction") + f" SELECT {REP} FROM rep")
def i14m(spark, d):
    return rounded(de.report(top(spark, d), "truth", "prediction"), 9, *METRICS)


@query("i15_binary_metrics", BIN + " SELECT count(*) FILTER (WHERE label = 'background' AND prediction = 'target') AS false_alarm_count, round(avg(CASE WHEN label = 'background' THEN CAST(prediction = 'target' AS INTEGER) END), 9) AS false_alarm_rate, count(*) FILTER (WHERE label = 'target' AND prediction <> 'target') AS missed_count, round(avg(CASE WHEN label = 'target' THEN CAST(prediction = 'target' AS INTEGER) END), 9) AS detection_rate, round(avg(CAST(visible <> 'inconclusive' AS INTEGER)), 9) AS coverage, round(1 - avg(CAST(visible <> 'inconclusive' AS INTEGER)), 9) AS rejection_rate FROM bin")
def i15(spark, d):
    return rounded(de.detection(binary(spark, d)), 9, "false_alarm_rate", "detection_rate", "coverage", "rejection_rate")


@query("i17_fold_dispersion", report_sql(TOP, "top", "truth", "prediction", "fold") + " SELECT round(avg(balanced_accuracy), 9) AS mean, round(stddev_pop(balanced_accuracy), 9) AS dispersion FROM rep")
def i17(spark, d):
    return rounded(de.fold_dispersion(top(spark, d), "truth", "prediction"), 9, "mean", "dispersion")


#: The reference's published comparison of band counts.
@query("i18_band_selection", "WITH c AS (SELECT [4, 10, 20][1 + CAST(l_linenumber % 3 AS INTEGER)] AS band_count, round(avg(l_discount) * 10, 4) AS mean, round(stddev_pop(l_tax), 4) AS dispersion FROM lineitem GROUP BY 1) SELECT CAST(band_count AS INTEGER) AS band_count, mean, dispersion FROM c WHERE round((SELECT max(mean) FROM c) - mean, 12) <= 0.02 ORDER BY dispersion, band_count LIMIT 1")
def i18(spark, d):
    """The rule over a comparison made of the lines' discounts and taxes; j02_band_comparison has that of fitted models."""
    count = F.array(F.lit(4), F.lit(10), F.lit(20))[(F.col("l_linenumber") % 3).cast("int")]
    c = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(count.alias("band_count")).agg(F.round(F.avg("l_discount") * 10, 4).cast("double").alias("mean"), F.round(F.stddev_pop("l_tax"), 4).alias("dispersion"))
    return de.select_band_count(c)


@query("i19_stage_reliability", report_sql(TOP, "top", "truth", "prediction", "fold") + ", b AS (SELECT 1 / 3.0::DOUBLE AS base), o AS (SELECT avg(r) AS ba FROM (SELECT truth, avg(CAST(prediction = truth AS INTEGER)) AS r FROM top GROUP BY truth)) SELECT 'model' AS stage, count(*) FILTER (WHERE round(balanced_accuracy, 12) > round(base, 12)) AS improved_folds, (min(round(o.ba, 12)) > min(round(base, 12))) AND count(*) FILTER (WHERE round(balanced_accuracy, 12) > round(base, 12)) >= 4 AS enabled FROM rep, b, o")
def i19(spark, d):
    p = top(spark, d)
    stage = lambda df: rounded(df, 12, "balanced_accuracy").withColumn("stage", F.lit("model"))
    dummy = spark.createDataFrame([("model", round(1 / 3, 12))], "stage string, balanced_accuracy double")
    return de.stage_reliability(stage(de.report(p, "truth", "prediction", ["fold"])), stage(de.report(p, "truth", "prediction")), dummy, 5)


@query("i20_policy", "SELECT stage, passed AS reserved_passed, dev AND passed AS enabled FROM (SELECT *, CASE WHEN stage = 'activity' THEN n >= 6 AND ba > base AND fa <= 0.10 AND det >= 0.90 ELSE n >= 8 AND ba > base END AS passed FROM (SELECT ['activity', 'model', 'mode_bebop', 'mode_ar'][1 + CAST(l_linenumber % 4 AS INTEGER)] AS stage, min(l_linenumber) % 2 = 0 OR min(l_linenumber) = 3 AS dev, round(avg(l_discount) * 10, 4) AS ba, round(avg(l_tax) * 12.6, 4) AS base, count(DISTINCT l_suppkey) AS n, round(avg(l_tax), 4) AS fa, round(1 - avg(l_discount), 4) AS det FROM lineitem GROUP BY 1))")
def i20(spark, d):
    """The policy over stages made of the lines; j15_policy has those of a calibration."""
    stage = F.array(*[F.lit(s) for s in ("activity", "model", "mode_bebop", "mode_ar")])[(F.col("l_linenumber") % 4).cast("int")]
    first = F.min("l_linenumber")
    rate = lambda c: F.round(c, 4).cast("double")
    s = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(stage.alias("stage")).agg(((first % 2 == 0) | (first == 3)).alias("development_enabled"), rate(F.avg("l_discount") * 10).alias("balanced_accuracy"), rate(F.avg("l_tax") * 12.6).alias("dummy"), F.count_distinct("l_suppkey").cast("int").alias("n_groups"), rate(F.avg("l_tax")).alias("false_alarm_rate"), rate(1 - F.avg("l_discount")).alias("detection_rate"))
    return de.conservative_policy(s).select("stage", "reserved_passed", "enabled")


def hierarchy_groups(spark, d):
    feats = stored(features4(spark, d))
    g = group_scores(spark, d, feats).withColumnRenamed("s_act", "score")
    parts = feats.groupBy("group_id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    vectors, params, limit = guard_parts(spark, d, feats)
    domain = robust.check_domain(vectors, params, limit, GUARD).select("group_id", (F.round("distance", 9) <= F.round("threshold", 9)).alias("in_domain"))
    quality = robust.check_quality(feats, robust.calibrate_quality(feats.where("label = 'target'"))).select("group_id", F.col("accepted").alias("quality_ok"))
    g = de.top_predictions(g, ["s_a", "s_b", "s_c"], "s_").withColumnRenamed("prediction", "model_top").withColumnRenamed("margin", "model_gap")
    g = de.top_predictions(g, ["s_m1", "s_m2"], "s_").withColumnRenamed("prediction", "mode_top").withColumnRenamed("margin", "mode_gap")
    return rounded(g, 9, "model_gap", "mode_gap").join(parts, "group_id").join(domain, "group_id").join(quality, "group_id")


@query("i24_hierarchy", BIN + "," + DOMAIN[len(FEATURE_CTES) + 1 :] + "," + QUALITY[len(FEATURE_CTES) + 1 :] + f""",
qo AS (SELECT group_id, count(*) FILTER (WHERE c > u) = 0 AS ok FROM pc, lim GROUP BY group_id),
lg AS (SELECT group_id, unnest(['a', 'b', 'c']) AS c, unnest([s_a, s_b, s_c]) AS s FROM gs), rk AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY s DESC, c) AS r FROM lg),
tp AS (SELECT group_id, min(c) FILTER (WHERE r = 1) AS mt, round(max(s) FILTER (WHERE r = 1) - max(s) FILTER (WHERE r = 2), 9) AS mg FROM rk GROUP BY group_id),
al AS (SELECT b.*, round(ds.distance, 9) <= round(th.threshold, 9) AS dom, qo.ok, tp.mt, tp.mg, CASE WHEN s_m1 >= s_m2 THEN 'm1' ELSE 'm2' END AS ot, round(abs(s_m1 - s_m2), 9) AS og FROM bin b JOIN ds ON b.group_id = ds.group_id JOIN qo ON b.group_id = qo.group_id JOIN tp ON b.group_id = tp.group_id CROSS JOIN th),
gt AS (SELECT *, CASE WHEN parts_used < 2 THEN 'parts' WHEN NOT dom THEN 'domain' WHEN NOT ok THEN 'quality' WHEN margin < {REJECTION} THEN 'activity_margin' END AS gate FROM al),
st AS (SELECT *, gate IS NULL AND s_act >= {THRESHOLD} AS go, gate IS NULL AND s_act >= {THRESHOLD} AND mg >= 0.01 AS hm FROM gt),
md AS (SELECT *, CASE WHEN hm AND mt = 'c' THEN 'm1' WHEN hm AND mt = 'a' AND og >= 0.02 THEN ot END AS mode FROM st)
SELECT group_id, CASE WHEN gate IS NOT NULL THEN 'inconclusive' WHEN s_act < {THRESHOLD} THEN 'background' ELSE 'target' END AS state, CASE WHEN hm THEN mt END AS model, mode,
  CASE WHEN mode IS NOT NULL THEN 'mode' WHEN hm THEN 'model' WHEN gate IS NULL THEN 'activity' ELSE 'none' END AS last_level,
  CASE WHEN gate IS NOT NULL THEN gate WHEN go AND NOT hm THEN 'model_margin' WHEN hm AND mt = 'b' THEN 'mode_disabled' WHEN hm AND mt = 'a' AND og < 0.02 THEN 'mode_margin' END AS stopped_reason FROM md""")
def i24(spark, d):
    out = de.hierarchy(hierarchy_groups(spark, d), (THRESHOLD, REJECTION), 0.01, {"a": 0.02, "b": 0.02}, {"model": True, "mode_a": True, "mode_b": False}, {"c": "m1"})
    return out.select("group_id", "state", "model", "mode", "last_level", "stopped_reason")


@query("i16_exact_rate", TOP + " SELECT round(avg(CAST(prediction = truth AS INTEGER)), 9) AS exact_rate FROM top")
def i16(spark, d):
    return rounded(de.exact_rate(top(spark, d), {"prediction": "truth"}), 9, "exact_rate")


@query("i25_ranked_hypotheses", TOP.split(",\nlg")[0].rsplit(", lg AS", 1)[0] + ", lg AS (SELECT group_id, unnest(['a', 'b', 'c']) AS class, unnest([s_a, s_b, s_c]) AS s FROM gs) SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY s DESC, class) AS INTEGER) AS rank, class, round(s, 6) AS score FROM lg")
def i25(spark, d):
    out = group_scores(spark, d).select("group_id", F.posexplode(de.ranked(["s_a", "s_b", "s_c"], "s_")).alias("i", "h"))
    return out.select("group_id", (F.col("i") + 1).alias("rank"), "h.class", F.round("h.score", 6).alias("score"))


@query("i26_ungated", BIN + " SELECT label, prediction, count(*) AS groups FROM bin GROUP BY label, prediction")
def i26(spark, d):
    return binary(spark, d).groupBy("label", "prediction").agg(F.count("*").alias("groups"))


@query("j11_case_table", FEATURE_CTES + " SELECT group_id, part, count(*) AS windows, round(median(rms), 6) AS rms, round(median(crest_factor), 6) AS crest_factor, round(median(dominant_psd_hz), 6) AS dominant_psd_hz, round(median(psd_total_power), 6) AS psd_total_power FROM ft GROUP BY group_id, part")
def j11(spark, d):
    cols = ["rms", "crest_factor", "dominant_psd_hz", "psd_total_power"]
    return rounded(features4(spark, d).groupBy("group_id", "part").agg(F.count("*").alias("windows"), *[F.median(c).alias(c) for c in cols]), 6, *cols)


J14 = ("rms", "mean_power", "peak", "crest_factor", "psd_total_power", "spectral_centroid_hz", "spectral_bandwidth_hz")


@query("j14_feature_summary", FEATURE_CTES + " SELECT part, " + ", ".join(f"round(median({c}){' / 1e6' if c.endswith('hz') else ''}, 9) AS {c.removesuffix('_hz') + '_mhz' if c.endswith('hz') else c}" for c in J14) + " FROM ft GROUP BY part")
def j14(spark, d):
    m = robust.exact_medians(features4(spark, d), ["part"], J14)
    return m.select("part", *[F.round(F.col(c) / (1e6 if c.endswith("hz") else 1.0), 9).alias(c.removesuffix("_hz") + "_mhz" if c.endswith("hz") else c) for c in J14])


@query("j10_quality_by_label", QUALITY + ", q AS (SELECT group_id, min(label) AS label, count(*) FILTER (WHERE c > u) = 0 AS ok FROM pc, lim GROUP BY group_id) SELECT label, count(*) AS groups, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS accepted FROM q GROUP BY label")
def j10(spark, d):
    feats = stored(features4(spark, d))
    ok = robust.check_quality(feats, robust.calibrate_quality(feats.where("label = 'target'")))
    labels = feats.groupBy("group_id").agg(F.min("label").alias("label"))
    return ok.join(labels, "group_id").groupBy("label").agg(F.count("*").alias("groups"), F.count_if("accepted").alias("accepted"))



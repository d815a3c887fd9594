"""Bundles: the models, thresholds, guards and policy that development data give, saved as plain values, and decisions on unknown inputs with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.functions.columns import require_columns
from spectrel.functions.tables import stored, written
from spectrel.operators import decision as de
from spectrel.operators import learning as le
from spectrel.operators import robust
from spectrel.operators.features import feature_columns, fold_bands
from spectrel.sources.sinks import load_parameters, save_parameters

BAND_COUNTS = (4, 10, 20)
#: What every bundle has.
REQUIRED = ("band_count", "feature_columns", "models", "thresholds", "stage_reliability", "domain_guard", "quality_guard")
#: A model with a single mode.
SINGLE_MODE = {"phantom": "connected"}


def check_partitions(features: DataFrame) -> None:
    """An error if the features hold the held-out partition, or lack development or evaluation."""
    have = {r[0] for r in features.select("partition").distinct().limit(10).collect()}
    if "holdout" in have:
        raise ValueError("calibration takes no held-out partition")
    if not {"dev", "eval"} <= have:
        raise ValueError("features of development and evaluation are needed")


def band_variants(features: DataFrame, bands: int, counts: Sequence[int] = BAND_COUNTS) -> tuple[DataFrame, list[str], dict[int, tuple[int, ...]]]:
    """features with the relative powers for several numbers of bands side by side, all feature columns, and the places of each variant's."""
    wide, columns, places = features, [], {}
    for n in counts:
        folded = fold_bands(features.select("window_id", *[c for c in feature_columns(bands) if c.startswith("rel_")]), bands, n) if n != bands else None
        names = {c: f"{c}_of_{n}" for c in feature_columns(n) if c.startswith("rel_")}
        if folded is None:
            wide = wide.withColumns({new: F.col(old) for old, new in names.items()})
        else:
            width = bands // n
            wide = wide.withColumns({f"rel_band_power_{i + 1}_of_{n}": sum((F.col(f"rel_band_power_{j}") for j in range(i * width + 2, (i + 1) * width + 1)), F.col(f"rel_band_power_{i * width + 1}")) for i in range(n)})
        base = [c for c in feature_columns(n) if not c.startswith("rel_")]
        for c in [*base, *names.values()]:
            if c not in columns:
                columns.append(c)
        places[n] = tuple(columns.index(c) for c in [*base, *names.values()])
    return wide, columns, places


def stage_runs(groups: DataFrame, stages: Sequence[le.StageSpec], seed: int, splits: int, copies: int = 1) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """((run, group_id, label, fold), the stages' classes): the folds of each stage, as runs copy * stages + stage."""
    out, classes = None, []
    for i, stage in enumerate(stages):
        own = le.filter_stage(groups, stage)
        classes.append(tuple(le.class_names(own, stage.label)))
        one = le.group_folds(own, stage.label, splits, seed).select("group_id", F.col(stage.label).alias("label"), "fold")
        one = one.select(F.explode(F.array(*[F.lit(c * len(stages) + i) for c in range(copies)])).alias("run"), "group_id", "label", "fold")
        out = one if out is None else out.unionByName(one)
    return out, classes


def binary(classes: Sequence[str]) -> bool:
    return set(classes) == {de.TARGET, de.BACKGROUND}


def decide_runs(scored: DataFrame, keys: Sequence[str], is_binary) -> DataFrame:
    """From group scores (keys, group_id, fold, label, scores: an array of class, score): score (of the target), threshold, prediction and margin. Where is_binary
    holds, the target is predicted from the keys' best threshold on, else the best class; equal scores go to the first class."""
    keys = list(keys)
    items = F.array_sort(F.transform("scores", lambda s: F.struct((-F.round(s["score"], 9)).alias("n"), s["class"].alias("c"))))
    target = F.array_max(F.transform(F.filter("scores", lambda s: s["class"] == de.TARGET), lambda s: s["score"]))
    by = scored.select(*keys, "group_id", "fold", "label", items.alias("s_"), F.round(target, 9).alias("score"), "parts_used")
    by = written(by.withColumn("binary", is_binary), "scores")
    limits = de.choose_thresholds(by.where("binary"), keys, "score").select(*keys, "threshold")
    out = by.join(F.broadcast(limits), keys, "left")
    hit = F.when(F.col("score") >= F.col("threshold"), de.TARGET).otherwise(de.BACKGROUND)
    top, gap = F.col("s_")[0]["c"], F.coalesce(F.try_element_at("s_", F.lit(2))["n"], F.lit(0.0)) - F.col("s_")[0]["n"]
    return out.select(*keys, "group_id", "fold", "label", "parts_used", "score", "threshold", F.when(F.col("binary"), hit).otherwise(top).alias("prediction"), F.round(F.when(F.col("binary"), F.abs(F.col("score") - F.col("threshold"))).otherwise(gap), 9).alias("margin"))


def prior_predictions(rows: DataFrame, runs: DataFrame, splits: int) -> DataFrame:
    """(run, group_id, fold, label, prediction): the most frequent class among the rows of the other folds, the first of equals."""
    size = rows.groupBy("group_id").agg(F.count("*").alias("w_"))
    by = runs.join(size, "group_id").groupBy("run", "fold", "label").agg(F.sum("w_").alias("w_"))
    cells = by.select("run", F.col("fold").alias("f_"), "label", "w_").join(F.broadcast(rows.sparkSession.range(splits).select(F.col("id").cast("int").alias("fold"))), F.col("f_") != F.col("fold"))
    best = F.min_by("label", F.struct((-F.col("w_")).alias("n"), "label")).alias("prediction")
    return runs.join(F.broadcast(cells.groupBy("run", "fold", "label").agg(F.sum("w_").alias("w_")).groupBy("run", "fold").agg(best)), ["run", "fold"])


def compare_bands(dev: DataFrame, bands: int, stages: Sequence[le.StageSpec] = le.STAGES, splits: int = 5, seed: int = 42, counts: Sequence[int] = BAND_COUNTS) -> tuple[DataFrame, DataFrame, list[str], dict[int, tuple[int, ...]]]:
    """(decided, runs, columns, places): the out-of-fold decisions of every stage with every number of bands (run = bands' place * stages + stage), all
    models fitted together."""
    wide, columns, places = band_variants(dev, bands, counts)
    groups = stored(dev.groupBy("group_id").agg(*[F.min(c).alias(c) for c in ("activity", "model", "mode")]))
    decided, runs = compare_blocks(le.pack(wide, columns), groups, columns, places, 1, stages, splits, seed, counts)
    return decided, runs, columns, places


def compare_blocks(packed: DataFrame, groups: DataFrame, columns: Sequence[str], places: Mapping[int, tuple[int, ...]], tables: int = 1, stages: Sequence[le.StageSpec] = le.STAGES, splits: int = 5, seed: int = 42, counts: Sequence[int] = BAND_COUNTS) -> tuple[DataFrame, DataFrame]:
    """(decided, runs) as compare_bands(), from blocks of features (le.pack), of one or several tables (t_) with the same groups: run = (table * numbers of bands + bands' place) * stages +
    stage. All models of all tables are fitted together."""
    runs, classes = stage_runs(groups, stages, seed, splits, len(counts))
    runs = stored(runs)
    specs = [le.ModelSpec(classes[i], places[n]) for n in counts for i in range(len(stages))]
    scored = le.oof_scores(packed, columns, runs, specs, splits, tables)
    is_binary = F.pmod(F.col("run"), F.lit(len(stages))).isin([i for i in range(len(stages)) if binary(classes[i])])
    return stored(decide_runs(scored, ["run"], is_binary)), runs


def variant_places(bands: int, counts: Sequence[int] = BAND_COUNTS) -> tuple[list[str], dict[int, tuple[int, ...]], np.ndarray]:
    """(columns, places) of band_variants(), and the matrix that makes these columns of feature_columns(bands)."""
    base = feature_columns(bands)[: -bands]
    columns, places = list(base), {}
    matrix = [np.eye(len(base) + bands)[: len(base)]]
    for n in counts:
        if bands % n:
            raise ValueError("the number of bands is a multiple of the target")
        places[n] = (*range(len(base)), *range(len(columns), len(columns) + n))
        columns += [f"{c}_of_{n}" for c in feature_columns(n)[len(base) :]]
        matrix.append(np.concatenate([np.zeros((n, len(base))), np.repeat(np.eye(n), bands // n, axis=1)], axis=1))
    return columns, places, np.concatenate(matrix).T


def comparison_by_table(decided: DataFrame, stages: int, counts: Sequence[int] = BAND_COUNTS) -> DataFrame:
    """(table, band_count, mean, dispersion) of compare_blocks(): over the stages, of the balanced accuracy and of its deviation between folds."""
    whole = de.report(decided, "label", "prediction", ["run"]).select("run", "balanced_accuracy")
    each = whole.join(de.fold_dispersion(decided, "label", "prediction", ["run"]).select("run", "dispersion"), "run")
    place = F.floor(F.col("run") / stages).cast("int")
    count = F.element_at(F.array(*[F.lit(n) for n in counts]), F.pmod(place, F.lit(len(counts))) + 1)
    table = F.floor(place / len(counts)).cast("int")
    return each.groupBy(table.alias("table"), count.alias("band_count")).agg(F.round(F.avg("balanced_accuracy"), 9).alias("mean"), F.round(F.avg("dispersion"), 9).alias("dispersion"))


def comparison_of(decided: DataFrame, stages: int, counts: Sequence[int] = BAND_COUNTS) -> DataFrame:
    """(band_count, mean, dispersion): over the stages, of the balanced accuracy and of its deviation between folds."""
    return comparison_by_table(decided, stages, counts).drop("table")


def compare_tables(packed: DataFrame, facts: DataFrame, tables: int, columns: Sequence[str], places: Mapping[int, tuple[int, ...]], stages: Sequence[le.StageSpec] = le.STAGES, splits: int = 5, seed: int = 42, counts: Sequence[int] = BAND_COUNTS) -> DataFrame:
    """(table, band_count, mean, dispersion) of several tables of features (blocks of le.pack). facts: group_id, activity, model, mode. Where all tables have the same groups their models are
    fitted together; else (recordings too short for some windows) a table's groups and folds are its own, and tables are fitted one by one."""
    facts = facts.groupBy("group_id").agg(*[F.min(c).alias(c) for c in ("activity", "model", "mode")])
    have = stored(packed.groupBy("group_id").agg(F.sort_array(F.collect_set("t_")).alias("in_")))
    if have.where(F.size("in_") < tables).isEmpty():
        decided, _ = compare_blocks(packed, stored(have.select("group_id").join(facts, "group_id")), columns, places, tables, stages, splits, seed, counts)
        return comparison_by_table(decided, len(stages), counts)
    out = None
    for t in range(tables):
        groups = stored(have.where(F.array_contains("in_", t)).select("group_id").join(facts, "group_id"))
        decided, _ = compare_blocks(packed.where(F.col("t_") == t).withColumn("t_", F.lit(0)), groups, columns, places, 1, stages, splits, seed, counts)
        one = comparison_by_table(decided, len(stages), counts).withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def calibrate(features: DataFrame, bands: int = 20, stages: Sequence[le.StageSpec] = le.STAGES, splits: int = 5, seed: int = 42) -> tuple[dict, DataFrame, DataFrame]:
    """(bundle, report, comparison) from features of development and evaluation (bands relative powers; activity, model, mode, partition).

    The number of bands, thresholds, margins and guards come from development only; evaluation gives the reserved report that the policy asks for. report: a
    row a stage with the development's, the baseline's and the reserved figures."""
    features = stored(features)
    check_partitions(features)
    dev, reserved = features.where("partition = 'dev'"), features.where("partition = 'eval'")
    decided, runs, _, _ = compare_bands(dev, bands, stages, splits, seed)
    comparison = stored(comparison_of(decided, len(stages)))
    chosen = de.select_band_count(comparison).first()["band_count"]
    first = BAND_COUNTS.index(chosen) * len(stages)
    own = decided.where((F.col("run") >= first) & (F.col("run") < first + len(stages))).withColumn("run", F.col("run") - first)
    columns = feature_columns(chosen)
    dev, reserved = (x if chosen == bands else fold_bands(x, bands, chosen) for x in (dev, reserved))
    fits = le.fit_finals(dev, columns, stages)
    prior = prior_predictions(dev, runs.where(F.col("run") < len(stages)), splits)
    base = {r.run: r.balanced_accuracy for r in de.report(prior, "label", "prediction", ["run"]).collect()}
    whole = {r.run: r for r in de.report(own, "label", "prediction", ["run"]).collect()}
    by_fold: dict[int, list[float]] = {}
    for r in de.report(own, "label", "prediction", ["run", "fold"]).collect():  # a row a stage and fold
        by_fold.setdefault(r.run, []).append(r.balanced_accuracy)
    limits = {r.run: r.threshold for r in own.groupBy("run").agg(F.min("threshold").alias("threshold")).collect()}
    models, thresholds, reliability, rows = {}, {}, {}, []
    for i, stage in enumerate(stages):
        margin = de.choose_rejection(own.where(F.col("run") == i)).first()
        models[stage.name] = fits.as_dict(i)
        thresholds[stage.name] = {"decision": limits[i], "rejection_margin": margin["rejection_margin"] if margin else 0.0}
        better = sum(v > base[i] for v in by_fold[i])
        reliability[stage.name] = {"enabled": whole[i].balanced_accuracy > base[i] and better >= splits - 1, "improved_folds": better, "total_folds": splits, "baseline": base[i]}
        seen = reserved_report(reserved, stage, models[stage.name], thresholds[stage.name])
        rows.append((stage.name, whole[i].balanced_accuracy, base[i], thresholds[stage.name]["decision"], thresholds[stage.name]["rejection_margin"], better, reliability[stage.name]["enabled"], seen["balanced_accuracy"], seen["n_groups"], seen["false_alarm_rate"], seen["detection_rate"]))
    vectors = stored(robust.group_vectors(dev, columns))  # quantiles read them several times
    params, limit = robust.calibrate_domain(vectors, columns)
    centre = params.first()
    quality = robust.calibrate_quality(dev).first()
    spark = features.sparkSession
    report = spark.createDataFrame(rows, "stage string, dev_balanced_accuracy double, dummy double, decision double, rejection_margin double, improved_folds int, development_enabled boolean, balanced_accuracy double, n_groups int, false_alarm_rate double, detection_rate double")
    bundle = {"band_count": chosen, "feature_columns": columns, "models": models, "thresholds": thresholds, "stage_reliability": reliability, "domain_guard": {"centre": {c: centre[c]["centre"] for c in columns}, "scale": {c: centre[c]["scale"] for c in columns}, "threshold": limit.first()["threshold"]}, "quality_guard": {"upper_limit": quality["upper_limit"]}}
    return bundle, report, comparison


def reserved_report(reserved: DataFrame, stage: le.StageSpec, model: Mapping, limits: Mapping) -> dict:
    """The stage's figures on reserved groups, rejected ones counted as wrong; none where no group is of the stage."""
    rows = le.model_scores(reserved.where(stage.where), dict(model))
    cols = [f"score__{c}" for c in model["classes"]]
    groups = robust.group_scores(rows, cols, stage.label).withColumnsRenamed({stage.label: "label"})
    if binary(model["classes"]):
        out = de.decide_binary(groups.withColumn("score", F.round(f"score__{de.TARGET}", 9)), limits["decision"], limits["rejection_margin"])
    else:
        out = de.top_predictions(groups, cols)
        out = out.withColumn("visible", F.when(F.round("margin", 9) < limits["rejection_margin"], de.INCONCLUSIVE).otherwise(F.col("prediction")))
    out = stored(out)
    whole, seen = de.report(out).first(), de.detection(out).first() if binary(model["classes"]) else None
    return {"balanced_accuracy": whole["balanced_accuracy"] if whole else None, "n_groups": int(whole["n_groups"] or 0) if whole else 0, "false_alarm_rate": seen["false_alarm_rate"] if seen else None, "detection_rate": seen["detection_rate"] if seen else None}


def with_policy(bundle: dict, report: DataFrame) -> dict:
    """The bundle with the conservative policy applied: a stage is enabled if development enabled it and its reserved figures pass."""
    rows = {r.stage: r for r in de.conservative_policy(report).collect()}  # a row a stage
    stages = {name: {**bundle["stage_reliability"][name], "reserved_passed": bool(rows[name].reserved_passed), "enabled": bool(rows[name].enabled)} for name in bundle["stage_reliability"]}
    return {**bundle, "stage_reliability": stages, "policy": {"required_parts": ["L", "H"], "enabled": {k: v["enabled"] for k, v in stages.items()}}}


def save_bundle(spark: SparkSession, bundle: dict, path: str) -> None:
    save_parameters(spark, bundle, path)


def load_bundle(spark: SparkSession, path: str) -> dict:
    """The bundle; an error where the version, a part, a stage or the features don't fit."""
    got = load_parameters(spark, path, REQUIRED)
    if set(got["models"]) != {s.name for s in le.STAGES}:
        raise ValueError("the bundle lacks stages of the hierarchy")
    if list(got["feature_columns"]) != feature_columns(int(got["band_count"])):
        raise ValueError("the bundle's features aren't those of its number of bands")
    return got


def decide(bundle: dict, features: DataFrame) -> DataFrame:
    """(group_id, parts, in_domain, quality_ok, score, state, model, mode, last_level, stopped_reason) of unknown inputs: no label is asked for or read."""
    columns = list(bundle["feature_columns"])
    require_columns(features, ["group_id", "part", *columns])
    spark = features.sparkSession
    features = stored(features.select("group_id", "part", *columns))
    scored, names = features, {}
    for name, model in bundle["models"].items():
        scored = le.model_scores(scored, {**model, "columns": columns}, f"{name}__")
        names[name] = [f"{name}__{c}" for c in model["classes"]]
    every = [c for cols in names.values() for c in cols]
    groups = robust.group_vectors(scored, every)
    groups = groups.withColumns({c: F.round(c, 9) for c in every}).withColumn("score", F.col(f"activity__{de.TARGET}"))
    for name in ("model", "mode_bebop", "mode_ar"):
        groups = de.top_predictions(groups, names[name], f"{name}__").withColumnsRenamed({"prediction": f"{name}_top", "margin": f"{name}_gap"})
        groups = groups.withColumn(f"{name}_gap", F.round(f"{name}_gap", 9))
    of_model = lambda what: F.when(F.col("model_top") == "bebop", F.col(f"mode_bebop_{what}")).when(F.col("model_top") == "ar", F.col(f"mode_ar_{what}"))
    groups = groups.withColumns({"mode_top": of_model("top"), "mode_gap": of_model("gap")})
    guard = bundle["domain_guard"]
    kind = ", ".join(f"`{c}` struct<centre:double,scale:double>" for c in columns)
    params = spark.createDataFrame([tuple((guard["centre"][c], guard["scale"][c]) for c in columns)], kind)
    limit = spark.createDataFrame([(guard["threshold"],)], "threshold double")
    domain = robust.check_domain(robust.group_vectors(features, columns), params, limit, columns).select("group_id", "in_domain")
    quality = robust.check_quality(features, spark.createDataFrame([(bundle["quality_guard"]["upper_limit"],)], "upper_limit double")).select("group_id", F.col("accepted").alias("quality_ok"))
    parts = features.groupBy("group_id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    groups = groups.join(parts, "group_id").join(domain, "group_id").join(quality, "group_id")
    t, on = bundle["thresholds"], {k: v["enabled"] for k, v in bundle["stage_reliability"].items()}
    out = de.hierarchy(groups, (t["activity"]["decision"], t["activity"]["rejection_margin"]), t["model"]["rejection_margin"], {m: t[f"mode_{m}"]["rejection_margin"] for m in ("bebop", "ar")}, on, SINGLE_MODE)
    return out.select("group_id", "parts", "in_domain", "quality_ok", "score", "state", "model", "mode", "last_level", "stopped_reason")

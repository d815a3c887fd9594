"""From group scores to decisions: top class, thresholds, rejection, reports, policy, and the gated hierarchy."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET, BACKGROUND, INCONCLUSIVE = "target", "background", "inconclusive"


def linear_scores(features: DataFrame, weights: Mapping[str, Mapping[str, float]], prefix: str = "score__", digits: int | None = None) -> DataFrame:
    """features with a score for each class of a frozen linear model: a logistic one of a single class (and the rest), else softmax."""
    def total(w):
        out = F.lit(float(w.get("intercept", 0.0)))
        for c, v in w.items():
            out = out if c == "intercept" else out + v * F.col(c)
        return out

    if len(weights) == 1:
        ((name, w),) = weights.items()
        return features.withColumn(prefix + name, 1 / (1 + F.exp(-total(w))))
    z = {name: F.exp(total(w)) for name, w in weights.items()}
    whole = sum(list(z.values())[1:], next(iter(z.values())))
    return features.withColumns({prefix + name: v / whole for name, v in z.items()})


def prior_scores(labels: DataFrame, to: DataFrame, label: str = "label", prefix: str = "score__") -> DataFrame:
    """to, with the share of each class in labels as its score."""
    counts = {r[0]: r[1] for r in labels.groupBy(label).count().orderBy(label).collect()}  # a row a class
    n = sum(counts.values())
    return to.withColumns({prefix + c: F.lit(v / n) for c, v in counts.items()})


def ranked(columns: Sequence[str], prefix: str = "score__") -> Column:
    """An array of (score, class), the highest score first, equal ones by class."""
    items = F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(c.removeprefix(prefix)).alias("class")) for c in columns])
    return F.transform(F.array_sort(items), lambda s: F.struct((-s["neg"]).alias("score"), s["class"].alias("class")))


def top_predictions(scores: DataFrame, columns: Sequence[str], prefix: str = "score__") -> DataFrame:
    """scores with prediction and margin (to the second; the score itself where there is one class)."""
    out = scores.withColumn("r_", ranked(columns, prefix))
    margin = F.col("r_")[0]["score"] - F.col("r_")[1]["score"] if len(columns) > 1 else F.col("r_")[0]["score"]
    return out.withColumn("prediction", F.col("r_")[0]["class"]).withColumn("margin", margin).drop("r_")


def even(start: float, stop: float, count: int) -> list[float]:
    return [start + (stop - start) * i / (count - 1) for i in range(count)]


def sums_below(rows: DataFrame, keys: Sequence[str], t: str, values: Sequence[str]) -> DataFrame:
    """rows with v_below for each of the values: its sum over the rows of the same keys with a smaller t. t is unique by the keys and mostly
    from 0 to 1: rows are summed up in 4,096 buckets of t first, so that no task sorts all of them."""
    bucket = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(t))) * 4096)
    dealt = rows.withColumn("b_", bucket)
    before = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy(*keys, "b_").agg(*[F.sum(v).alias(f"{v}_b") for v in values])
    offsets = whole.select(*keys, "b_", *[F.coalesce(F.sum(f"{v}_b").over(before), F.lit(0)).alias(f"{v}_o") for v in values])  # 4,097 rows a key
    within = Window.partitionBy(*keys, "b_").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"{v}_i": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(offsets, [*keys, "b_"])
    return dealt.select(*rows.columns, *[(F.col(f"{v}_i") + F.col(f"{v}_o")).alias(f"{v}_below") for v in values])


def choose_thresholds(scores: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, threshold, balanced_accuracy): the candidate with the best balanced accuracy, then nearest to 0.5, then smallest. Candidates are
    0.5, 181 values from 0.05 to 0.95 and all scores of the keys. Equal scores are counted first; then running sums in order of the score
    replace the product of scores and candidates."""
    keys = list(keys)
    own = scores.groupBy(*keys, F.col(score).alias("t")).agg(F.count_if(F.col(label) == TARGET).alias("p"), F.count_if(F.col(label) != TARGET).alias("n"))
    total = own.groupBy(*keys).agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    grid = F.explode(F.array(*[F.lit(round(v, 9)) for v in [0.5, *even(0.05, 0.95, 181)]])).alias("t")
    zero = F.lit(0).cast("long")
    values = own.unionByName(total.select(*keys, grid, zero.alias("p"), zero.alias("n"))).groupBy(*keys, "t").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = sums_below(values, keys, "t", ["p", "n"]).join(F.broadcast(total), keys) if keys else sums_below(values, keys, "t", ["p", "n"]).crossJoin(F.broadcast(total))
    parts = F.coalesce(F.try_divide(F.col("p_all") - F.col("p_below"), F.col("p_all")), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("n_below"), F.col("n_all")), F.lit(0.0))
    ba = F.round(parts / (F.when(F.col("p_all") > 0, 1).otherwise(0) + F.when(F.col("n_all") > 0, 1).otherwise(0)), 12)
    best = F.min(F.struct((-ba).alias("b"), F.round(F.abs(F.col("t") - 0.5), 9).alias("off"), "t")).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, F.col("best.t").alias("threshold"), (-F.col("best.b")).alias("balanced_accuracy"))


def choose_threshold(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (threshold, balanced_accuracy), as choose_thresholds() without keys."""
    return choose_thresholds(scores, [], score, label)


def choose_rejection(predictions: DataFrame, label: str = "label", cost: float = 0.25, most: float = 0.30) -> DataFrame:
    """One row (rejection_margin, risk): the candidate with the smallest risk, the smallest of equals. A margin below it rejects; a candidate that
    rejects more than `most` is out. Risk: by true class the mean of (wrong and kept) + cost * rejected, then the mean over classes."""
    wrong = (F.col("prediction") != F.col(label)).cast("long")
    own = predictions.groupBy(F.col("margin").alias("t"), F.col(label).alias("c")).agg(F.count("*").alias("n"), F.sum(wrong).alias("w"))
    total = own.groupBy("c").agg(F.sum("n").alias("n_all"), F.sum("w").alias("w_all"))  # a row a class
    fixed = predictions.sparkSession.createDataFrame([(round(v, 9),) for v in even(0.0, 0.5, 101)], "t double")
    grid = own.select("t").unionByName(fixed).distinct()
    cells = grid.crossJoin(F.broadcast(total)).join(own, ["t", "c"], "left").select("t", "c", "n_all", "w_all", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0)).alias("w"))
    rows = sums_below(cells, ["c"], "t", ["n", "w"])
    risk = (F.col("w_all") - F.col("w_below") + cost * F.col("n_below")) / F.col("n_all")
    out = rows.groupBy("t").agg(F.round(F.avg(risk), 12).alias("risk"), (F.sum("n_below") / F.sum("n_all")).alias("rate"))
    return out.where(F.col("rate") <= most).orderBy("risk", "t").limit(1).select(F.col("t").alias("rejection_margin"), "risk")


def decide_binary(scores: DataFrame, threshold: Column | float, rejection: Column | float, score: str = "score") -> DataFrame:
    """scores with prediction, margin, rejected and visible (the prediction, inconclusive where rejected)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    r = rejection if isinstance(rejection, Column) else F.lit(rejection)
    out = scores.withColumn("prediction", F.when(F.col(score) >= t, TARGET).otherwise(BACKGROUND)).withColumn("margin", F.abs(F.col(score) - t))
    out = out.withColumn("rejected", F.col("margin") < r)
    return out.withColumn("visible", F.when(F.col("rejected"), INCONCLUSIVE).otherwise(F.col("prediction")))


def report(predictions: DataFrame, label: str = "label", prediction: str = "visible", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, accuracy, balanced_accuracy, precision_macro, recall_macro, f1_macro, n_groups): balanced accuracy over the true labels, the macro values over
    true and predicted labels, zero where nothing can be divided."""
    keys = list(keys)
    cells = predictions.groupBy(*keys, F.col(label).alias("t"), F.col(prediction).alias("p")).count()
    each = cells.select(*keys, F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(0).alias("as_p"), F.col("count").alias("as_t"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.col("count").alias("as_p"), F.lit(0).alias("as_t"), F.lit(0).alias("hit")))).alias("e")).select(*keys, "e.*")
    by = each.groupBy(*keys, "c").agg(F.sum("as_p").alias("np"), F.sum("as_t").alias("nt"), F.sum("hit").alias("hit"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pr, rc = div(F.col("hit"), F.col("np")), div(F.col("hit"), F.col("nt"))
    by = by.select(*keys, "nt", "hit", pr.alias("pr"), rc.alias("rc"), div(2 * pr * rc, pr + rc).alias("f1"))
    return by.groupBy(*keys).agg((F.sum("hit") / F.sum("nt")).alias("accuracy"), F.avg(F.when(F.col("nt") > 0, F.col("rc"))).alias("balanced_accuracy"), F.avg("pr").alias("precision_macro"), F.avg("rc").alias("recall_macro"), F.avg("f1").alias("f1_macro"), F.sum("nt").cast("long").alias("n_groups"))


def detection(predictions: DataFrame, label: str = "label", prediction: str = "prediction", visible: str = "visible", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, false_alarm_count, false_alarm_rate, missed_count, detection_rate, coverage, rejection_rate), from the prediction before rejection but for the last two."""
    t, b = F.col(label) == TARGET, F.col(label) == BACKGROUND
    alarm = F.col(prediction) == TARGET
    share = lambda cond, on: F.avg(F.when(on, cond.cast("double")))
    kept = F.avg((F.col(visible) != INCONCLUSIVE).cast("double"))
    return predictions.groupBy(*keys).agg(F.count_if(b & alarm).alias("false_alarm_count"), share(alarm, b).alias("false_alarm_rate"), F.count_if(t & ~alarm).alias("missed_count"), share(alarm, t).alias("detection_rate"), kept.alias("coverage"), (1 - kept).alias("rejection_rate"))


def fold_dispersion(predictions: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mean, dispersion): of the folds' balanced accuracies, the population's deviation."""
    folds = report(predictions, label, prediction, [*keys, "fold"])
    return folds.groupBy(*keys).agg(F.avg("balanced_accuracy").alias("mean"), F.stddev_pop("balanced_accuracy").alias("dispersion"))


def select_band_count(comparison: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row: of those within the tolerance of the best mean, the one with the smallest dispersion, then the fewest bands."""
    best = comparison.agg(F.max("mean").alias("best_"))
    return comparison.crossJoin(F.broadcast(best)).where(F.round(F.col("best_") - F.col("mean"), 12) <= tolerance).orderBy("dispersion", "band_count").limit(1).drop("best_")


def select_configuration(comparison: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row: of the configurations within the tolerance of the best mean, the one with the smallest dispersion, then the simplest. comparison: configuration,
    simplicity, mean, dispersion."""
    best = comparison.agg(F.max("mean").alias("best_"))
    near = comparison.crossJoin(F.broadcast(best)).where(F.round(F.col("best_") - F.col("mean"), 12) <= tolerance)
    return near.orderBy("dispersion", "simplicity").limit(1).drop("best_")


def stage_reliability(folds: DataFrame, overall: DataFrame, dummy: DataFrame, n_splits: int) -> DataFrame:
    """(stage, improved_folds, enabled): better than the prior baseline on the whole and in all folds but one.

    folds: stage, fold, balanced_accuracy. overall, dummy: stage, balanced_accuracy."""
    d = dummy.select("stage", F.col("balanced_accuracy").alias("base"))
    better = folds.join(d, "stage").groupBy("stage").agg(F.count_if(F.col("balanced_accuracy") > F.col("base")).alias("improved_folds"))
    out = overall.join(d, "stage").join(better, "stage")
    return out.select("stage", "improved_folds", ((F.col("balanced_accuracy") > F.col("base")) & (F.col("improved_folds") >= n_splits - 1)).alias("enabled"))


def conservative_policy(stages: DataFrame) -> DataFrame:
    """stages with reserved_passed and enabled. stages: stage, development_enabled, balanced_accuracy, dummy, n_groups, false_alarm_rate, detection_rate."""
    better = F.col("balanced_accuracy") > F.col("dummy")
    activity = (F.col("n_groups") >= 6) & better & (F.coalesce("false_alarm_rate", F.lit(1.0)) <= 0.10) & (F.coalesce("detection_rate", F.lit(0.0)) >= 0.90)
    passed = F.when(F.col("stage") == "activity", activity).otherwise((F.col("n_groups") >= 8) & better)
    return stages.withColumn("reserved_passed", passed).withColumn("enabled", F.col("development_enabled") & F.col("reserved_passed"))


def hierarchy(groups: DataFrame, activity: tuple[float, float], model_margin: float, mode_margins: Mapping[str, float], enabled: Mapping[str, bool], single_mode: Mapping[str, str]) -> DataFrame:
    """groups with state, model, mode, last_level and stopped_reason.

    groups has parts (array), in_domain, quality_ok, score, model_top, model_gap and mode_top, mode_gap (of the model's mode stage). The gates
    are asked in this order: parts, domain, quality, margin, threshold; then the model stage, then a mode that a model has alone, then the mode stage."""
    t, reject = activity
    both = F.array_contains("parts", "L") & F.array_contains("parts", "H")
    near = F.abs(F.col("score") - t) < reject
    gate = F.when(~both, "parts").when(~F.col("in_domain"), "domain").when(~F.col("quality_ok"), "quality").when(near, "activity_margin")
    on = gate.isNull() & (F.col("score") >= t)
    state = F.when(gate.isNotNull(), INCONCLUSIVE).when(F.col("score") < t, BACKGROUND).otherwise(TARGET)
    has_model = on & F.lit(enabled.get("model", False)) & (F.col("model_gap") >= model_margin)
    alone = F.lit(None).cast("string")
    for m, mode in single_mode.items():
        alone = F.when(F.col("model_top") == m, mode).otherwise(alone)
    stage_on, stage_margin = F.lit(False), F.lit(0.0)
    for m, v in mode_margins.items():
        stage_on = F.when(F.col("model_top") == m, F.lit(enabled.get(f"mode_{m}", False))).otherwise(stage_on)
        stage_margin = F.when(F.col("model_top") == m, v).otherwise(stage_margin)
    mode = F.when(has_model & alone.isNotNull(), alone).when(has_model & stage_on & (F.col("mode_gap") >= stage_margin), F.col("mode_top"))
    reason = gate
    reason = reason.when(on & ~F.lit(enabled.get("model", False)), "model_disabled").when(on & ~has_model, "model_margin")
    reason = reason.when(has_model & alone.isNull() & ~stage_on, "mode_disabled").when(has_model & alone.isNull() & (F.col("mode_gap") < stage_margin), "mode_margin")
    level = F.when(mode.isNotNull(), "mode").when(has_model, "model").when(state != INCONCLUSIVE, "activity").otherwise("none")
    return groups.withColumns({"state": state, "model": F.when(has_model, F.col("model_top")), "mode": mode, "last_level": level, "stopped_reason": reason})


def exact_rate(decided: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row (exact_rate): how often all of the columns agree with what is expected, nulls included."""
    same = F.lit(True)
    for got, want in expected.items():
        same = same & F.col(got).eqNullSafe(F.col(want))
    return decided.agg(F.avg(same.cast("double")).alias("exact_rate"))


def p_values(permuted: DataFrame, observed: DataFrame, value: str = "balanced_accuracy") -> DataFrame:
    """One row (observed, permutations, mean, p_value): the share of permutations that reach the observed value, itself counted among them."""
    rows = permuted.crossJoin(F.broadcast(observed.select("observed")))
    hit = F.count_if(F.col(value) >= F.col("observed"))
    return rows.groupBy("observed").agg(F.count("*").alias("permutations"), F.avg(value).alias("mean"), ((hit + 1) / (F.count("*") + 1)).alias("p_value"))


def is_close(a: float, b: float) -> bool:
    """Whether two rates agree, as far as numbers written in a manifest do."""
    return math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-8)

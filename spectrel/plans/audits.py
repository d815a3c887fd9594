"""End-to-end audit reports: conditions of inputs (noise, tones, impulses, bits, chunks, parts) through features, scores and decisions to metrics, and calibration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrel.functions.columns import gaussian
from spectrel.functions.tables import shared_folder, stored, written
from spectrel.operators import bundle as bu
from spectrel.operators import conditioning as co
from spectrel.operators import decision as de
from spectrel.operators import filters as fi
from spectrel.operators import framing as fr
from spectrel.operators import kernels, packed, robust
from spectrel.operators import recordings as re
from spectrel.operators import synth as sy
from spectrel.operators.features import FeatureConfig, fold_bands
from spectrel.plans.decision_queries import ACTIVITY, GROUP_CTES, GUARD, REJECTION, REP, SCORE_COLUMNS, THRESHOLD, METRICS, report_sql
from spectrel.plans.fixtures import EMB_SQL, FS, SHIP_SQL, PARTITIONS, contents, emb_arrays, emb_windows, manifest, one_line_series, planted, planted_pieces
from spectrel.plans.registry import query
from spectrel.plans.series_queries import PRE, STARTS, frames_sql, hex_uniform, normal_sql
from spectrel.plans.spectral_queries import FEATURE_CTES, FEATURES4, features4, rounded
from spectrel.sources import archives as ar
from spectrel.sources import readers as rd
from spectrel.sources import sinks as sk
from spectrel.sources.batches import BatchTable

Condition = Callable[[DataFrame], DataFrame]
WINDOW_KEYS = ("group_id", "part", "label", "window_id", "condition")


def sweep(windows: DataFrame, conditions: Mapping[str, Condition]) -> DataFrame:
    """windows (long form) once for each condition, as the condition's function changes them, with the column condition."""
    out = None
    for name, change in conditions.items():
        one = change(windows).withColumn("condition", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def features_of(windows: DataFrame, fs: float, bands: int, nperseg: int, noverlap: int | None = None, window: str = "hann", keys: Sequence[str] = WINDOW_KEYS) -> DataFrame:
    """Windows in long form to arrays (one shuffle), then the Arrow kernel; those that are arrays (win) already aren't shuffled."""
    if "win" in windows.columns:
        return kernels.feature_table(windows.select(*keys, "win"), fs, bands, nperseg, window, "win", noverlap)
    arrays = windows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("win"))
    return kernels.feature_table(arrays, fs, bands, nperseg, window, "win", noverlap)


def decided(features: DataFrame, threshold: float, rejection: float, weights=ACTIVITY) -> DataFrame:
    """Group decisions by condition of the frozen activity model."""
    scored = de.linear_scores(features, weights).withColumnRenamed("score__target", "s")
    parts = scored.groupBy("condition", "group_id", "part").agg(F.min("label").alias("label"), F.median("s").alias("s"))
    groups = parts.groupBy("condition", "group_id").agg(F.min("label").alias("label"), F.round(F.avg("s"), 9).alias("score"), F.count("*").alias("parts_used"))
    return de.decide_binary(groups, threshold, rejection)


def audit(windows: DataFrame, fs: float, threshold: float, rejection: float) -> DataFrame:
    """(condition, the report, false alarms, detection, coverage) of windows with their condition, as samples or as arrays."""
    features = features_of(windows, fs, 4, 32, 16) if "n" in windows.columns else kernels.feature_table(windows, fs, 4, 32, "hann", "win", 16)
    rows = stored(decided(features, threshold, rejection))  # a row a group and condition
    report = de.report(rows, prediction="visible", keys=["condition"])
    return report.join(de.detection(rows, keys=["condition"]), "condition")


def restored(change: Condition) -> Condition:
    """A change of parts' samples, applied to windows laid end to end, as the reference signals are."""
    def run(windows: DataFrame) -> DataFrame:
        place = windows.withColumn("m", F.col("n")).withColumn("n", F.col("window_id") * 64 + F.col("n"))
        return change(place).withColumn("n", F.col("m")).drop("m")

    return run


def bits(n: int) -> Condition:
    return lambda w: co.quantize(w, n).withColumn("x", F.col("xq")).drop("xq")


def only_part(part: str) -> Condition:
    return lambda w: w.where(F.col("part") == part)


#: Features of windows under conditions: emb with the condition in the group's and the window's name, then the same steps.
def conditions_sql(emb: str) -> str:
    ctes = FEATURE_CTES.replace("WITH " + EMB_SQL, "WITH " + EMB_SQL.replace("emb AS MATERIALIZED", "emb0 AS MATERIALIZED") + ", emb AS MATERIALIZED (" + emb + ")")
    return ctes + f""",
ws AS (SELECT split_part(group_id, '|', 2) AS condition, split_part(group_id, '|', 1) AS group_id, part, label, {SCORE_COLUMNS['s_act']} AS s FROM ft),
gp AS (SELECT condition, group_id, part, min(label) AS label, median(s) AS s FROM ws GROUP BY condition, group_id, part),
gs AS MATERIALIZED (SELECT condition, group_id, min(label) AS label, round(avg(s), 9) AS s_act FROM gp GROUP BY condition, group_id),
bin AS (SELECT *, CASE WHEN s_act >= {THRESHOLD} THEN 'target' ELSE 'background' END AS prediction, CASE WHEN abs(s_act - {THRESHOLD}) < {REJECTION} THEN 'inconclusive' WHEN s_act >= {THRESHOLD} THEN 'target' ELSE 'background' END AS visible FROM gs)"""


def audit_sql(emb: str) -> str:
    rates = "SELECT condition AS dc, count(*) FILTER (WHERE label = 'background' AND prediction = 'target') AS false_alarm_count, round(avg(CASE WHEN label = 'target' THEN CAST(prediction = 'target' AS INTEGER) END), 9) AS detection_rate, round(avg(CAST(visible <> 'inconclusive' AS INTEGER)), 9) AS coverage FROM bin GROUP BY condition"
    return report_sql(conditions_sql(emb), "bin", "label", "visible", "condition") + f", dts AS ({rates}) SELECT condition, {REP}, false_alarm_count, detection_rate, coverage FROM rep JOIN dts ON condition = dc"


def audited(spark, d, conditions):
    """conditions: functions of the windows, or windows with their condition."""
    out = audit(sweep(emb_windows(spark, d), conditions) if isinstance(conditions, dict) else conditions, FS, THRESHOLD, REJECTION)
    out = rounded(out, 9, *METRICS, "detection_rate", "coverage")
    return out.select("condition", *METRICS, "n_groups", "false_alarm_count", "detection_rate", "coverage")


LEVELS, REPEATS = (-5, 0, 5, 10, 20), 5


def noise_grid(windows: DataFrame, levels: Sequence[int], repeats: int, seed: int = 11) -> DataFrame:
    """windows (arrays of 64 samples) once for each noise level and repetition, with noise of the part's RMS and of the repetition's seed; condition: level/repetition. Samples stay in
    their arrays."""
    spark = windows.sparkSession
    grid = spark.createDataFrame([(r,) for r in range(repeats)], "rep int")
    power = F.aggregate("win", F.lit(0.0), lambda a, v: a + v * v)
    rms = windows.groupBy("group_id", "part").agg(F.sqrt(F.sum(power) / F.sum(F.size("win"))).alias("rms"))
    rows = windows.join(rms, ["group_id", "part"]).crossJoin(F.broadcast(grid)).repartition("window_id", "rep")
    noise = lambda i: gaussian(F.col("rep") + seed, F.col("group_id"), F.col("part"), F.col("window_id") * 64 + i)
    rows = rows.withColumn("noise", F.transform("win", lambda v, i: noise(i)))
    rows = rows.withColumn("snr", F.explode(F.array(*[F.lit(v) for v in levels])))  # a repetition's noise is made once for all levels
    win = F.zip_with("win", "noise", lambda v, e: v + F.col("rms") * F.pow(F.lit(10.0), -F.col("snr") / 20) * e)
    return rows.withColumn("win", win).withColumn("condition", F.concat_ws("/", "snr", "rep")).drop("rms", "snr", "rep", "noise")


NOISE_ID = "concat(CAST(11 + rep AS VARCHAR), ':', group_id, ':', part, ':', CAST(window_id * 64 + n AS VARCHAR))"
NOISE_SQL = audit_sql(f"SELECT concat(group_id, '|', CAST(snr AS VARCHAR), '/', CAST(rep AS VARCHAR)) AS group_id, part, label, window_id * 1000 + (snr + 5) * 10 + rep AS window_id, n, x + r * power(10, -snr / 20.0::DOUBLE) * {normal_sql(NOISE_ID)} AS x FROM (SELECT *, sqrt(avg(x * x) OVER (PARTITION BY group_id, part)) AS r FROM emb0), (SELECT unnest([-5, 0, 5, 10, 20]) AS snr), (SELECT unnest(range(5)) AS rep)")


@query("j05_noise_sensitivity", NOISE_SQL)
def j05(spark, d):
    """Five levels, five repetitions each."""
    return audited(spark, d, noise_grid(emb_arrays(spark, d), LEVELS, REPEATS))


SUMMARY = ("balanced_accuracy", "detection_rate", "coverage")


@query("j05_noise_summary", "WITH w AS (" + NOISE_SQL + ") SELECT CAST(split_part(condition, '/', 1) AS INTEGER) AS snr, " + ", ".join(f"round({f}({m}), 6) AS {m}_{n}" for m in SUMMARY for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM w GROUP BY ALL")
def j05s(spark, d):
    """By level the mean, least and largest figures of the repetitions."""
    rows = j05(spark, d).withColumn("snr", F.split("condition", "/")[0].cast("int"))
    return rows.groupBy("snr").agg(*[F.round(f(m), 6).alias(f"{m}_{n}") for m in SUMMARY for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def window_slice(windows: DataFrame, start: int, stop: int) -> DataFrame:
    """Of windows with their place idx those from start to before stop."""
    return windows.where((F.col("idx") >= start) & (F.col("idx") < stop))


@query("j03_chunks", audit_sql("SELECT concat(group_id, '|', CAST(c AS VARCHAR)) AS group_id, part, label, window_id * 10 + c AS window_id, n, x FROM emb0 JOIN (SELECT window_id, ntile(4) OVER (PARTITION BY group_id, part ORDER BY window_id) - 1 AS c FROM (SELECT DISTINCT window_id, group_id, part FROM emb0)) USING (window_id)"))
def j03c(spark, d):
    """Four consecutive slices of every part's windows, each decided alone."""
    place = F.row_number().over(Window.partitionBy("group_id", "part").orderBy("window_id")) - 1  # a part's windows, a few hundred
    w = emb_arrays(spark, d).withColumn("idx", place)
    rows = fr.chunks(w, 4).withColumn("condition", F.col("chunk").cast("string"))
    return audited(spark, d, rows.drop("idx", "chunk"))


@query("h10_views", "WITH " + EMB_SQL + ", i AS (SELECT window_id, row_number() OVER (PARTITION BY group_id, part ORDER BY window_id) - 1 AS idx FROM (SELECT DISTINCT window_id, group_id, part FROM emb)) SELECT group_id, part, count(DISTINCT window_id) AS windows, round(sqrt(avg(x * x)), 9) AS rms FROM emb JOIN i USING (window_id) WHERE part = 'L' AND idx >= 1 AND idx < 4 GROUP BY group_id, part")
def h10(spark, d):
    """A view of one part and a range of its windows."""
    place = F.row_number().over(Window.partitionBy("group_id", "part").orderBy("window_id")) - 1
    w = window_slice(only_part("L")(emb_arrays(spark, d)).withColumn("idx", place), 1, 4).select("group_id", "part", "window_id", F.explode("win").alias("x"))
    return w.groupBy("group_id", "part").agg(F.count_distinct("window_id").alias("windows"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 9).alias("rms"))


@query("j03_bits", audit_sql("SELECT concat(group_id, '|', CAST(b AS VARCHAR)) AS group_id, part, label, window_id * 100 + b AS window_id, n, (round_even(CAST((greatest(-1, least(1, x / s)) + 1) / 2 * (2 ** b - 1) AS DOUBLE), 0) / (2 ** b - 1) * 2 - 1) * s AS x FROM (SELECT *, max(abs(x)) OVER (PARTITION BY group_id, part) AS s FROM emb0), (SELECT unnest([4, 6, 8, 12]) AS b)"))
def j03b(spark, d):
    return audited(spark, d, {str(v): bits(v) for v in (4, 6, 8, 12)})


@query("j03_parts", audit_sql("SELECT concat(group_id, '|', c) AS group_id, part, label, window_id * 100 + i AS window_id, n, x FROM emb0 JOIN (SELECT unnest(['L', 'H', 'LH']) AS c, unnest([1, 2, 3]) AS i) ON contains(c, part)"))
def j03p(spark, d):
    return audited(spark, d, {"L": only_part("L"), "H": only_part("H"), "LH": lambda w: w})


IMPULSE_ID = "concat('5:', group_id, ':', part, ':', CAST(window_id * 64 + n AS VARCHAR))"


@query("j06_stressors", audit_sql(f"""SELECT concat(group_id, '|tone') AS group_id, part, label, window_id * 100 + 1 AS window_id, n, x + y * (r / power(10, 6 / 20.0::DOUBLE) / o) AS x FROM (SELECT *, sqrt(avg(x * x) OVER w) AS r, sqrt(avg(y * y) OVER w) AS o FROM (SELECT *, sin(2 * pi() * 5 * ((window_id * 64 + n) / 64.0::DOUBLE) + CASE part WHEN 'H' THEN 0 ELSE pi() / 7 END) AS y FROM emb0) WINDOW w AS (PARTITION BY group_id, part))
UNION ALL SELECT concat(group_id, '|impulses'), part, label, window_id * 100 + 2, n, x + CASE WHEN o <= greatest(1, round_even(CAST(c * 0.02::DOUBLE AS DOUBLE), 0)) THEN (CASE WHEN v < 0.5 THEN -1 ELSE 1 END) * 6 * r ELSE 0 END FROM (SELECT *, row_number() OVER (PARTITION BY group_id, part ORDER BY u, window_id * 64 + n) AS o FROM (SELECT *, {hex_uniform(IMPULSE_ID)} AS u, {hex_uniform(IMPULSE_ID, 1)} AS v, count(*) OVER w AS c, sqrt(avg(x * x) OVER w) AS r FROM emb0 WINDOW w AS (PARTITION BY group_id, part)))"""))
def j06(spark, d):
    return audited(spark, d, {"tone": restored(lambda w: sy.add_tone(w, FS, 5.0, 6.0)), "impulses": restored(lambda w: sy.add_impulses(w, 0.02, 6.0, 5))})


@query("j07_blind_evaluation", GROUP_CTES + f", r AS (SELECT group_id, CASE WHEN s_act >= {THRESHOLD} THEN 'target' ELSE 'background' END AS state FROM gs), e AS (SELECT group_id, label AS expected FROM gs) SELECT expected, state, count(*) AS groups FROM r JOIN e USING (group_id) GROUP BY expected, state")
def j07(spark, d):
    """Decisions are made without labels; what was expected is joined to them afterwards, and every group must have it."""
    feats = features4(spark, d)
    blind = decided(feats.withColumn("label", F.lit(None).cast("string")).withColumn("condition", F.lit("")), THRESHOLD, 0.0)
    expected = feats.groupBy("group_id").agg(F.min("label").alias("expected"))
    out = blind.select("group_id", F.col("prediction").alias("state")).join(expected, "group_id", "left")
    checked = F.coalesce("expected", F.raise_error(F.lit("a group has no expectation")).cast("string"))
    return out.groupBy(checked.alias("expected"), "state").agg(F.count("*").alias("groups"))


@query("j09_out_of_domain")
def j09(spark, d):
    """The synthetic controls against the domain guard of the windows' features: all are to be rejected."""
    params, limit = robust.calibrate_domain(stored(robust.group_vectors(features4(spark, d), GUARD)), GUARD)
    w = sy.controls(spark).withColumn("window_id", F.floor(F.col("n") / 64)).withColumn("n", F.pmod("n", F.lit(64))).withColumn("label", F.lit("control")).withColumn("condition", F.lit(""))
    found = robust.group_vectors(features_of(w, FS, 4, 32, 16), GUARD)
    return robust.check_domain(found, params, limit, GUARD)


@query("j08_filtered_background")
def j08(spark, d):
    """Background records through a bandstop filter, as an external challenge: how many stay background."""
    b, a = fi.design_iir("bandstop", FS, [6.0, 10.0], 2)
    arrays = emb_windows(spark, d).where("label = 'background'").groupBy("group_id", "part", "label", "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("x"))
    rows = fi.apply_filter(arrays, b, a).drop("x").withColumnRenamed("y", "win").withColumn("condition", F.lit("bandstop"))
    out = decided(kernels.feature_table(rows, FS, 4, 32, "hann", "win", 16), THRESHOLD, REJECTION)
    return out.select("group_id", "score", "visible")


#: The configuration of the suppliers' recordings.
CONFIG = FeatureConfig(64, 32, 7, 4, 32, "hann", FS)
CONFIG20 = FeatureConfig(64, 32, 7, 20, 32, "hann", FS)
#: Windows of the recordings in place of embeddings, with 64 samples; from there on the features' SQL is the same.
FRAMES_SQL = f"""{SHIP_SQL}, {PRE}, {frames_sql(64, 32)}, {STARTS}, nmb AS (SELECT group_id, part, CAST(idx AS BIGINT) AS idx, row_number() OVER (PARTITION BY group_id, part ORDER BY idx) - 1 AS number FROM chosen),
emb AS MATERIALIZED (SELECT pre.group_id, pre.part, pre.label, concat(pre.group_id, '_', lower(pre.part), ':', CAST(number AS VARCHAR)) AS window_id, pre.n - nmb.idx * 32 AS n, x FROM nmb JOIN pre ON nmb.group_id = pre.group_id AND nmb.part = pre.part AND pre.n >= nmb.idx * 32 AND pre.n < nmb.idx * 32 + 64)"""
FILE_CTES = FEATURE_CTES.replace("WITH " + EMB_SQL, "WITH " + FRAMES_SQL)
PARTITION_SQL = "CASE WHEN (k // 10) % 10 < 6 THEN 'dev' WHEN (k // 10) % 10 < 9 THEN 'eval' ELSE 'holdout' END"
FILE_ROWS = FILE_CTES + f", o AS (SELECT *, CAST(substr(group_id, 3) AS BIGINT) AS k FROM ft) SELECT window_id, group_id, part, {PARTITION_SQL} AS partition, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES4)} FROM o"


def recorded(spark, d):
    """(manifest, contents as arrays) of the suppliers' recordings."""
    return manifest(spark, d), contents(spark, d).select("path", rd.numbers(F.col("text")).alias("x"))


@query("g13_file_features", FILE_ROWS)
def g13(spark, d):
    """From files as text to features: the reader, the rate check, conditioning, evenly spread windows, the kernel."""
    out = re.file_features(*recorded(spark, d), CONFIG)
    return rounded(out.select("window_id", "group_id", "part", "partition", *FEATURES4), 6, *FEATURES4)


@query("g13_one_line_features", FILE_ROWS)
def g13_files(spark, d):
    """The same from files of one line on disk: read by byte ranges, a row a sample, so that no task holds a file. A file holds as many recordings as fill it."""
    s = one_line_series(spark, d).select(F.concat(F.lit("raw/"), F.substring("group_id", 3, 20), "part", F.lit(".csv")).alias("path"), "n", "x")
    out = re.file_features(manifest(spark, d), s, CONFIG)
    return rounded(out.select("window_id", "group_id", "part", "partition", *FEATURES4), 6, *FEATURES4)


def zipped(spark, d) -> str:
    """A folder with the recordings as members of ZIP files, one for each last digit of the supplier."""
    at = f"{shared_folder(spark)}/zips-{uuid.uuid4().hex}"
    text = contents(spark, d)
    archive = F.concat(F.lit("s"), F.regexp_extract("path", r"(\d)[LH]\.csv$", 1))
    sk.write_zips(text.select(archive.alias("archive"), F.col("path").alias("member"), F.col("text").alias("content")), at)
    return at


@query("a16_zip_members", f"WITH {SHIP_SQL}, k AS (SELECT *, substr(group_id, 3) AS s FROM ser) SELECT 's' || right(s, 1) || '.zip' AS archive, 'raw/' || s || part || '.csv' AS member, count(*) AS samples, round(sum(x), 3) AS total, round(sum(n * x), 1) AS moment FROM k GROUP BY s, part")
def a16(spark, d):
    """The members of archives as samples, streamed out of them; nothing is unpacked."""
    s = ar.zip_samples(spark, zipped(spark, d))
    out = s.groupBy(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member").agg(F.count("*").alias("samples"), F.sum("x").alias("total"), F.sum(F.col("n") * F.col("x")).alias("moment"))
    return rounded(rounded(out, 3, "total"), 1, "moment")


@query("j15_zip_rebuild", f"SELECT * FROM ({FILE_ROWS}) WHERE partition <> 'holdout'")
def j15_zip(spark, d):
    """Features built anew from the archives."""
    at = f"{shared_folder(spark)}/rebuild-{uuid.uuid4().hex}"
    s = ar.zip_samples(spark, zipped(spark, d)).select(F.col("member").alias("path"), "n", "x")
    out = re.build_features(manifest(spark, d), s, at, CONFIG, batches=1)
    return rounded(out.select("window_id", "group_id", "part", "partition", *FEATURES4), 6, *FEATURES4)


@query("j01_feature_build", f"SELECT * FROM ({FILE_ROWS}) WHERE partition <> 'holdout'")
def j01(spark, d):
    """A build at a folder of its own that broke off: a batch is recorded, one is done twice, one was written and not recorded; then the whole build."""
    files, text = recorded(spark, d)
    at, batches = f"{shared_folder(spark)}/build-{uuid.uuid4().hex}", 4
    log = BatchTable(spark, at, batches)
    wanted = files.where("partition <> 'holdout'")
    for b, last in ((0, False), (0, False), (2, True)):
        some = wanted.where(re.batch_of(F.col("relative_path"), batches) == b)
        own = text.where(re.batch_of(F.col("path"), batches) == b)
        if last:
            log.write(b, {"features": re.file_features(some, own, CONFIG).limit(3)})
        else:
            re.build_batch(log, b, some, own, CONFIG)
    out = re.build_features(files, text, at, CONFIG, batches=batches)
    return rounded(out.select("window_id", "group_id", "part", "partition", *FEATURES4), 6, *FEATURES4)


def planted_features(spark, d, config=None, change=None, partitions=PARTITIONS, classes="true"):
    """Features (20 bands) of the recordings with tones, with the manifest's facts. change: of their samples, in long form. partitions, and with a change classes: which
    recordings, the others' lines aren't sorted."""
    config = config or CONFIG20
    if change is None:
        rows = packed.window_rows(planted_pieces(spark, d, partitions, config.window_size - 1), ["group_id", "part", *re.FACTS], config).where(classes)
        window_id = F.concat("group_id", F.lit("_"), F.lower("part"), F.lit(":"), F.col("number").cast("string"))
        return rows.select("group_id", "part", F.col("activity").alias("label"), window_id.alias("window_id"), "idx", "start", "stop", *[c for c in rows.columns if c not in ("group_id", "part", "number", "idx", "start", "stop", *re.FACTS)], *re.FACTS)
    facts = manifest(spark, d).select("group_id", "part", *re.FACTS)
    return re.window_features(change(planted(spark, d, partitions, classes)), config).join(facts, ["group_id", "part"])


_calibrated: dict = {}


def state_of(spark, folder: str) -> int:
    """A number that tells whether files under a folder are still the same: of their paths, lengths and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return int(files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0] or 0)


def calibrated(spark, d):
    """(bundle, report, comparison) of the recordings with tones: calibrated, the policy applied, saved and loaded again. Once a session for the same state of the
    table."""
    key = (spark.sparkContext.applicationId, d, state_of(spark, f"{d}/lineitem.parquet"))
    if key not in _calibrated:
        rows = planted_features(spark, d, partitions=["dev", "eval"])
        bundle, report, comparison = bu.calibrate(rows)
        path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
        bu.save_bundle(spark, bu.with_policy(bundle, report), path)
        _calibrated[key] = (bu.load_bundle(spark, path), report, comparison)
    return _calibrated[key]


@query("j02_calibration")
def j02(spark, d):
    """A row a stage: out-of-fold figures of development, the baseline's, thresholds, and the figures of reserved evaluation."""
    return calibrated(spark, d)[1]


@query("j02_band_comparison")
def j02b(spark, d):
    """4, 10 and 20 bands over four stages, five folds each: 60 models, fitted together."""
    return calibrated(spark, d)[2]


@query("j15_policy")
def j15(spark, d):
    """The conservative policy on a loaded bundle: which stages may decide."""
    b = calibrated(spark, d)[0]
    rows = [(k, v["reserved_passed"], v["enabled"]) for k, v in b["stage_reliability"].items()]
    return spark.createDataFrame(rows, "stage string, reserved_passed boolean, enabled boolean")


@query("j15_holdout_decisions")
def j15h(spark, d):
    """The held-out package, whose windows carry no label, decided with the loaded bundle; what was expected is joined afterwards."""
    rows = planted_features(spark, d, partitions=["holdout"])
    bundle = calibrated(spark, d)[0]
    features = fold_bands(rows, 20, bundle["band_count"]) if bundle["band_count"] != 20 else rows
    at = f"{shared_folder(spark)}/package-{uuid.uuid4().hex}"
    hidden = features.select("group_id", "part", "window_id", *bundle["feature_columns"])
    sk.write_package(hidden, f"{at}/windows", rows.select("group_id", "activity", "model", "mode").distinct(), f"{at}/catalogue")
    out = bu.decide(bundle, spark.read.parquet(f"{at}/windows"))
    expected = spark.read.parquet(f"{at}/catalogue").select("group_id", *[F.col(c).alias(f"expected_{c}") for c in ("activity", "model", "mode")])
    return out.join(expected, "group_id").select("group_id", "state", "model", "mode", "last_level", "stopped_reason", "expected_activity", "expected_model", "expected_mode")


@query("j12_result_tables")
def j12r(spark, d):
    """By level the baseline's, development's and reserved balanced accuracy, and coverage and accuracy of the held-out decisions."""
    stages = calibrated(spark, d)[1].select("stage", "dummy", F.col("dev_balanced_accuracy").alias("development"), F.col("balanced_accuracy").alias("evaluation"))
    held = stored(j15h(spark, d))
    rows = None
    for stage, got, expected, where in (("activity", "state", "expected_activity", "true"), ("model", "model", "expected_model", "expected_activity = 'target'"), ("mode", "mode", "expected_mode", "expected_activity = 'target'")):
        seen = held.where(where).withColumn("got", F.nullif(F.col(got), F.lit(de.INCONCLUSIVE)))
        right = F.avg(F.when(F.col("got").isNotNull(), (F.col("got") == F.col(expected)).cast("double")))
        one = seen.agg(F.lit(stage).alias("stage"), F.avg(F.col("got").isNotNull().cast("double")).alias("coverage"), right.alias("accuracy"))
        rows = one if rows is None else rows.unionByName(one)
    return stages.join(rows, "stage", "full")


#: The configurations of the sweep: name, window size and window, the simplest first.
SWEEP = (("n64_hann", 64, "hann"), ("n32_hann", 32, "hann"), ("n96_hann", 96, "hann"), ("n128_hann", 128, "hann"), ("n64_hamming", 64, "hamming"), ("n64_blackman", 64, "blackman"))


@query("j04_configurations")
def j04(spark, d):
    """Six configurations, 4, 10 and 20 bands, four stages, five folds: 360 models, fitted together. By configuration its best number of bands, and which one is chosen."""
    configs = [FeatureConfig(size, size // 2, 100, 20, 32, window, FS) for _, size, window in SWEEP]
    columns, places, matrix = bu.variant_places(20)
    pieces = planted_pieces(spark, d, ["dev"], max(c.window_size for c in configs) - 1)
    blocks = written(packed.part_blocks(pieces, configs, matrix), "parts")
    compared = stored(bu.compare_tables(blocks, pieces, len(configs), columns, places).coalesce(1))  # a row a configuration and number of bands
    out = None
    for i, (name, _, _) in enumerate(SWEEP):
        one = de.select_band_count(compared.where(F.col("table") == i)).select(F.lit(name).alias("configuration"), F.lit(i).alias("simplicity"), "band_count", "mean", "dispersion")
        out = one if out is None else out.unionByName(one)
    out = stored(out)
    best = de.select_configuration(out).select(F.col("configuration").alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("configuration") == F.col("best")).drop("best", "simplicity")


@query("j13_rehearsal")
def j13(spark, d):
    """The rehearsal's five checks: background and activity are decided, one part alone isn't, a copy is decided alike, transients stop a decision."""
    bundle = calibrated(spark, d)[0]
    bands = bundle["band_count"]

    def features(**which):
        rows = planted_features(spark, d, partitions=["eval"], **which)
        return stored((fold_bands(rows, 20, bands) if bands != 20 else rows).select("group_id", "part", "activity", *bundle["feature_columns"]))

    rows = features()
    facts = rows.select("group_id", "activity").distinct()
    plain = stored(bu.decide(bundle, rows).join(facts, "group_id"))
    again = stored(bu.decide(bundle, features())).select("group_id", F.col("state").alias("s2"), F.col("score").alias("c2"))
    single = bu.decide(bundle, rows.where("part = 'L'"))
    struck = bu.decide(bundle, features(change=lambda s: sy.add_impulses(s, 0.02, 12.0, 5), classes="activity = 'background'"))
    share = lambda ok: F.avg(ok.cast("double"))
    checks = {
        "background_resolved": plain.where("activity = 'background'").agg((share(F.col("state") == "background") > 0.5).alias("ok")),
        "activity_resolved": plain.where("activity = 'target'").agg((share(F.col("state") == "target") > 0.5).alias("ok")),
        "single_part_inconclusive": single.agg(F.bool_and((F.col("state") == de.INCONCLUSIVE) & (F.col("stopped_reason") == "parts")).alias("ok")),
        "copy_alike": plain.join(again, "group_id").agg(F.bool_and((F.col("state") == F.col("s2")) & (F.col("score") == F.col("c2"))).alias("ok")),
        "transients_inconclusive": struck.agg(F.bool_and(F.col("state") == de.INCONCLUSIVE).alias("ok")),
    }
    out = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("check"), F.coalesce("ok", F.lit(False)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out

"""From recordings to the feature table: rate check, conditioning, evenly spread windows, features and provenance; and builds that can be resumed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.functions.columns import require_columns
from spectrel.functions.tables import shared_folder
from spectrel.operators import conditioning as co
from spectrel.operators import decision as de
from spectrel.operators import framing as fr
from spectrel.operators import kernels, robust
from spectrel.operators.features import FeatureConfig, feature_columns
from spectrel.sources.batches import BatchTable
from spectrel.sources.sinks import run_facts

#: What a feature row tells of its file.
FACTS = ("code", "activity", "model", "mode", "segment", "partition", "relative_path", "sample_rate_hz")


def samples_of(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(group_id, part, label, n, x) of the files (relative_path, group_id, part, activity, sample_rate_hz) whose contents are at hand: (path, x) with a file as
    an array, or (path, n, x) with a row a sample, for files of any length. An error for a file without contents."""
    named = files.select("relative_path", "group_id", "part", F.col("activity").alias("label"))
    long = "n" in contents.columns
    have = contents.select(F.col("path").alias("relative_path"), *["n"] * long, "x")
    joined = named.join(have, "relative_path", "left")
    lacking = F.raise_error(F.concat(F.lit("no contents: "), "relative_path"))
    if long:
        return joined.select("group_id", "part", "label", F.coalesce("n", lacking.cast("long")).alias("n"), "x")
    out = joined.select("group_id", "part", "label", F.posexplode(F.coalesce("x", lacking.cast("array<double>"))).alias("n", "x"))
    return out.select("group_id", "part", "label", F.col("n").cast("long").alias("n"), "x")


def check_rates(files: DataFrame, fs: float) -> DataFrame:
    """files; an error if one's rate isn't the configuration's."""
    other = [r[0] for r in files.select("sample_rate_hz").distinct().limit(20).collect() if r[0] is None or not de.is_close(r[0], fs)]
    if other:
        raise ValueError(f"sampling rates that aren't {fs:g} Hz: {other}")
    return files


def window_features(samples: DataFrame, config: FeatureConfig) -> DataFrame:
    """(group_id, part, label, window_id, idx, start, stop, features) of conditioned samples."""
    config.validate()
    w = fr.sampled_windows(samples, config.window_size, config.hop_size, config.windows_per_part)
    window_id = F.concat("group_id", F.lit("_"), F.lower("part"), F.lit(":"), F.col("number").cast("string"))
    return kernels.feature_table(w.select("group_id", "part", "label", window_id.alias("window_id"), "idx", "start", "stop", "win"), config.fs, config.band_count, config.nperseg, config.window, "win")


def file_features(files: DataFrame, contents: DataFrame, config: FeatureConfig) -> DataFrame:
    """A row a window of every file, with its features and what the manifest says of the file. Contents come from any reader (path, x)."""
    require_columns(files, ["group_id", "part", *FACTS])
    check_rates(files, config.fs)
    samples = co.preprocess(samples_of(files, contents))
    facts = files.select("group_id", "part", *FACTS)
    return window_features(samples, config).join(facts, ["group_id", "part"])


def lock(spark: SparkSession, path: str, config: dict) -> None:
    """Writes the configuration of a run, or compares it with the one that is there; an error where they differ."""
    text = json.dumps(config, sort_keys=True)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        if spark.read.text(path).first()[0] != text:
            raise ValueError(f"the run at {path} has another configuration")
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def batch_of(path: Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(batches)).cast("int")


def expected_windows(files: DataFrame, samples: DataFrame, config: FeatureConfig) -> DataFrame:
    """(relative_path, samples, windows) of every file: how many samples it has, and how many windows its length gives."""
    length = samples.groupBy("group_id", "part").agg(F.count("*").alias("samples"))
    n = F.least(fr.frame_count(F.col("samples"), config.window_size, config.hop_size), F.lit(config.windows_per_part))
    return files.select("relative_path", "group_id", "part").join(length, ["group_id", "part"], "left").select("relative_path", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce(n, F.lit(0)).cast("long").alias("windows"))


def off_windows(features: DataFrame, expected: DataFrame) -> DataFrame:
    """(relative_path, windows, found) of files that haven't as many windows as their lengths give."""
    found = features.groupBy("relative_path").agg(F.count("*").alias("found"))
    both = expected.join(found, "relative_path", "full").select("relative_path", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("windows <> found")


def altered_files(files: DataFrame, digests: DataFrame) -> DataFrame:
    """The files whose SHA-256 (digests: path, sha256) isn't the manifest's, or isn't known."""
    have = digests.select(F.col("path").alias("relative_path"), F.lower("sha256").alias("sha256_"))
    return files.join(have, "relative_path", "left").where(~F.lower("sha256").eqNullSafe(F.col("sha256_"))).drop("sha256_")


def build_features(files: DataFrame, contents: DataFrame, out: str, config: FeatureConfig, partitions: Iterable[str] = ("dev", "eval"), allow_holdout: bool = False, batches: int = 16, digests: DataFrame | None = None, full: bool = False, dataset: Mapping[str, str] | None = None) -> DataFrame:
    """The feature table of the files of the partitions, built at `out` in batches of files; a file's batch follows from its path.

    A run that broke off goes on with the batches that aren't recorded (sources.batches), whatever it left behind. With each batch the number of samples and
    of windows that every file's length gives are recorded; at the end every file has to have just these, each batch its recorded rows, every wanted file has to be there, every
    feature has to be finite, every group has to have one partition and both parts, or it is an error. The same files and another configuration, or other files at the same place, are errors, too.

    files may have a column samples: how many a recording has; a shorter or longer one is an error. digests (path, sha256): what files have; one that differs from the manifest's
    sha256 is an error before anything is read. full: a recording too short for all windows is an error. dataset: what identifies the manifest (version, SHA-256), locked with the configuration.
    Contents are dealt to the batches once, if there is more than one batch. The run's manifest is written beside the table."""
    spark, partitions = files.sparkSession, sorted(set(partitions))
    if "holdout" in partitions and not allow_holdout:
        raise ValueError("the held-out partition is only extracted if that is allowed, and never to calibrate")
    wanted = files.where(F.col("partition").isin(partitions)).withColumn("batch", batch_of(F.col("relative_path"), batches))
    if digests is not None:
        robust.assert_none(altered_files(wanted, digests).select("relative_path"), "files whose SHA-256 isn't the manifest's")
    lock(spark, f"{out}/config", {"partitions": partitions, "features": asdict(config.validate()), "batches": batches, "dataset": dict(dataset or {})})
    table = BatchTable(spark, out, batches)
    todo = table.missing()
    if todo:
        own = contents.withColumn("batch", batch_of(F.col("path"), batches))
        if len(todo) > 1:
            own = dealt(own.where(F.col("batch").isin(todo)))
        for b in todo:
            build_batch(table, b, wanted.where(F.col("batch") == b).drop("batch"), own.where(F.col("batch") == b).drop("batch"), config, full)
    features, expected = table.read("features").drop("batch"), table.read("files").drop("batch")
    robust.assert_none(off_windows(features, expected).select("relative_path"), "files that haven't as many windows as their lengths give")
    robust.assert_none(wanted.join(expected, "relative_path", "full").where(F.col("batch").isNull() | F.col("windows").isNull()).select("relative_path"), "files that the manifest or the table lacks")
    robust.assert_none(robust.not_finite(features, feature_columns(config.band_count)).select("relative_path"), "features that aren't finite")
    robust.assert_none(robust.inconsistent(features, "group_id", "partition"), "groups in more than one partition")
    robust.assert_none(robust.missing_parts(features), "groups without both parts")
    totals = features.agg(F.count_distinct("relative_path").alias("files"), F.count_distinct("group_id").alias("groups"), F.count("*").alias("windows")).first().asDict()
    spark.createDataFrame([(json.dumps({"status": "features_ready", "counts": totals, **run_facts()}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return features


def dealt(contents: DataFrame) -> DataFrame:
    """contents (with batch), written once by batch, so that a batch reads its own."""
    path = f"{shared_folder(contents.sparkSession)}/contents-{uuid.uuid4().hex}"
    contents.write.partitionBy("batch").parquet(path)
    return contents.sparkSession.read.schema(contents.schema).parquet(path)


def build_batch(table: BatchTable, batch: int, files: DataFrame, contents: DataFrame, config: FeatureConfig, full: bool = False) -> None:
    """Writes a batch, checks what was written, and records it."""
    raw = samples_of(files, contents)
    expected = expected_windows(files, raw, config)
    attempt = table.write(batch, {"files": expected, "features": file_features(files, contents, config)})
    expected, features = table.attempted("files", batch, attempt), table.attempted("features", batch, attempt)
    if "samples" in files.columns:
        other = expected.join(files.select("relative_path", F.col("samples").alias("told")), "relative_path").where("samples <> told")
        robust.assert_none(other.select("relative_path"), "recordings that aren't as long as the manifest says")
    if full:
        robust.assert_none(expected.where(F.col("windows") < config.windows_per_part).select("relative_path"), "recordings too short for all windows")
    robust.assert_none(off_windows(features, expected).select("relative_path"), "files that haven't as many windows as their lengths give")
    table.record(batch, attempt, ["files", "features"])

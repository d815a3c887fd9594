"""Names of recordings: which files are signals, what their names say, and the catalogue of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of signal files, folders and a file that are passed over, and the pattern of names.
SUFFIXES = (".csv", ".mat", ".npy", ".npz", ".txt")
SKIPPED_FOLDERS, SKIPPED_FILE = ("interim", "processed"), "signal_manifest.csv"
NAME_PATTERN = r"(?i)^(\d{5})([LH])_(\d+)$"
#: Terms by which a file or folder is told to be background, and those of models.
BACKGROUND_TERMS = ("background", "no drone", "no_drone", "nodrone", "sin_dron", "fondo")
MODEL_TERMS = ("bebop", "ardrone", "ar_drone", "ar-drone", "phantom", "mambo")
#: Code, activity, model, mode and the last segment of each class.
CLASSES = (
    ("00000", "background", "none", "none", 20),
    ("10000", "target", "bebop", "connected", 20),
    ("10001", "target", "bebop", "hovering", 20),
    ("10010", "target", "bebop", "flying", 20),
    ("10011", "target", "bebop", "video", 20),
    ("10100", "target", "ar", "connected", 20),
    ("10101", "target", "ar", "hovering", 20),
    ("10110", "target", "ar", "flying", 20),
    ("10111", "target", "ar", "video", 17),
    ("11000", "target", "phantom", "connected", 20),
)
#: Normal forms of labels.
LABELS = {"background": "background", "no_drone": "background", "sin_dron": "background", "fondo": "background", "drone": "target", "dron": "target", "unknown": "unknown", "desconocido": "unknown"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def suffix(path: Column) -> Column:
    """The last suffix of the file's name, lower-cased, with its point; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES) | stem(path).rlike(NAME_PATTERN)


def parsed(path: Column) -> dict[str, Column]:
    """code, part (upper case), segment and segment_id; null where the name isn't of the pattern."""
    at = lambda i: F.nullif(F.regexp_extract(stem(path), NAME_PATTERN, i), F.lit(""))
    return {"code": at(1), "part": F.upper(at(2)), "segment": at(3), "segment_id": F.concat(at(1), F.lit("_"), at(3))}


def inferred_label(path: Column) -> Column:
    """From the code if the name is of the pattern, else from terms in the file's or folder's name; background terms win."""
    name, folder = F.lower(file_name(path)), F.lower(folder_name(path))
    code = parsed(path)["code"]
    out = F.when(code == "00000", "background").when(code.isNotNull(), "target")
    out = out.when(_any(BACKGROUND_TERMS, (name, folder)), "background")
    return out.when(name.contains("drone") | _any(MODEL_TERMS, (name, folder)), "target").otherwise("unknown")


def _any(terms: tuple[str, ...], where: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        for w in where:
            out = out | w.contains(t)
    return out


def signal_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes) of the signal files under a folder, in order of the path. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size_bytes"))
    parents = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    skipped = F.arrays_overlap(parents, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])) | (file_name(F.col("path")) == SKIPPED_FILE)
    return found.where(is_supported(F.col("path")) & ~skipped).orderBy("path")


def manifest(files: DataFrame, path: str = "path", prefix: str = "rec_") -> DataFrame:
    """files with label, group_id (prefix, code and segment, else the path without suffix), suffix, code, part and segment (empty where the name doesn't
    say)."""
    p = F.col(path)
    q = parsed(p)
    group = F.when(q["code"].isNotNull(), F.concat(F.lit(prefix), q["segment_id"])).otherwise(F.regexp_replace(p, r"\.[^./]*$", ""))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return files.select(*files.columns, inferred_label(p).alias("label"), group.alias("group_id"), suffix(p).alias("suffix"), empty(q["code"]).alias("code"), empty(q["part"]).alias("part"), empty(q["segment"]).alias("segment"))


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "code string, activity string, model string, mode string, max_segment int")


def selection(spark: SparkSession, prefix: str = "rec_") -> DataFrame:
    """The frozen selection: a row for each class, partition, segment and part. Groups are named by the prefix, the code and the segment."""
    c = classes(spark)
    tail = lambda back, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("max_segment") - back + i)
    ground = F.col("code") == "00000"
    dev = F.when(ground, F.sequence(F.lit(0), F.lit(9))).otherwise(F.sequence(F.lit(0), F.lit(4)))
    split = F.array(F.struct(F.lit("dev").alias("partition"), dev.alias("segments")), F.struct(F.lit("eval").alias("partition"), F.when(ground, tail(5, 3)).otherwise(tail(1, 1)).alias("segments")), F.struct(F.lit("holdout").alias("partition"), F.when(ground, tail(2, 3)).otherwise(tail(0, 1)).alias("segments")))
    rows = c.select("*", F.explode(split).alias("s")).select("code", "activity", "model", "mode", "max_segment", "s.partition", F.explode("s.segments").alias("segment"))
    rows = rows.crossJoin(F.broadcast(spark.createDataFrame([("L",), ("H",)], "part string")))
    return rows.withColumn("group_id", F.concat(F.lit(prefix), "code", F.lit("_"), F.col("segment").cast("string")))

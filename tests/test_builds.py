"""Builds that break off, are done twice or lose data; and text of any length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.functions.tables import stored
from spectrel.operators import recordings as re
from spectrel.operators.features import FeatureConfig
from spectrel.sources import longtext as lt
from spectrel.sources import readers as rd
from spectrel.sources import sinks
from spectrel.sources.batches import BatchTable

CONFIG = FeatureConfig(64, 32, 3, 4, 32, "hann", 64.0)


@pytest.fixture(scope="module")
def recordings(spark):
    """(files, contents): six groups of two parts, of 200 samples but one of 90, whose length gives one window only."""
    rng = np.random.default_rng(4)
    files, rows = [], []
    for i in range(6):
        for part in "LH":
            path, n = f"{i}{part}.csv", 90 if (i, part) == (3, "H") else 200
            files.append((f"g{i}", part, path, "10000", "target", "bebop", "connected", i, "dev" if i % 2 else "eval", 64.0, f"{i:064x}", n))
            rows.append((path, [float(v) for v in rng.standard_normal(n)]))
    names = "group_id string, part string, relative_path string, code string, activity string, model string, mode string, segment int, partition string, sample_rate_hz double, sha256 string, samples long"
    return stored(spark.createDataFrame(files, names)), stored(spark.createDataFrame(rows, "path string, x array<double>"))


def table(df):
    return sorted((r.window_id, r.relative_path, round(r.rms, 9), round(r.dominant_fft_hz, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def whole(recordings, tmp_path_factory):
    files, contents = recordings
    out = re.build_features(files, contents, str(tmp_path_factory.mktemp("whole")), CONFIG, batches=1)
    got = table(out)
    assert len(got) == 11 * 3 + 1 and len({r[0] for r in got}) == 34
    return got


class Kill(Exception):
    pass


@pytest.mark.parametrize("where", ["write_first", "write_second", "record"])
@pytest.mark.parametrize("after", [0, 1, 2])
def test_killed_anywhere(recordings, whole, tmp_path, monkeypatch, where, after):
    """Killed before or after an attempt's tables, or before its record, of any batch; then resumed."""
    files, contents = recordings
    left = {"n": after}

    def dying(method, stop):
        def run(self, *args):
            if left["n"] == 0:
                stop(self, *args)
                raise Kill
            left["n"] -= 1
            return method(self, *args)

        return run

    stops = {"write_first": ("write", lambda *a: None), "write_second": ("write", lambda self, b, t: BatchTable.folder(self, "features", b, "half") and t["features"].limit(2).write.parquet(self.folder("features", b, "half"))), "record": ("record", lambda *a: None)}
    name, stop = stops[where]
    with monkeypatch.context() as m:
        m.setattr(BatchTable, name, dying(getattr(BatchTable, name), stop))
        with pytest.raises(Kill):
            re.build_features(files, contents, str(tmp_path), CONFIG, batches=3)
    assert table(re.build_features(files, contents, str(tmp_path), CONFIG, batches=3)) == whole


def test_a_batch_done_twice(spark, recordings, whole, tmp_path):
    files, contents = recordings
    log = BatchTable(spark, str(tmp_path), 2)
    for b in (1, 1, 0, 1):
        re.build_batch(log, b, files.where(re.batch_of(F.col("relative_path"), 2) == b), contents.where(re.batch_of(F.col("path"), 2) == b), CONFIG)
    assert log.missing() == [] and len(list((tmp_path / "features").glob("batch=1/attempt=*"))) == 3
    assert table(re.build_features(files, contents, str(tmp_path), CONFIG, batches=2)) == whole


def parts(folder, table):
    return sorted(p for p in folder.glob(f"{table}/**/*.parquet") if p.stat().st_size > 0)


def test_lost_and_truncated_data_are_errors(recordings, tmp_path):
    files, contents = recordings
    for name, harm in (("gone", lambda p: p.unlink()), ("cut", lambda p: p.write_bytes(p.read_bytes()[: p.stat().st_size // 2]))):
        out = tmp_path / name
        re.build_features(files, contents, str(out), CONFIG, batches=1)
        victim = max(parts(out, "features"), key=lambda p: p.stat().st_size)
        harm(victim)
        (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
        with pytest.raises(Exception, match="recorded|footer|Parquet|parquet"):
            re.build_features(files, contents, str(out), CONFIG, batches=1).collect()


def test_short_files_are_errors(recordings, tmp_path):
    files, contents = recordings
    cut = contents.withColumn("x", F.when(F.col("path") == "1L.csv", F.slice("x", 1, 70)).otherwise(F.col("x")))
    with pytest.raises(ValueError, match="aren't as long.*1L.csv"):
        re.build_features(files, cut, str(tmp_path / "a"), CONFIG, batches=1)
    with pytest.raises(ValueError, match="too short for all windows.*3H.csv"):
        re.build_features(files, contents, str(tmp_path / "b"), CONFIG, batches=1, full=True)
    with pytest.raises(Exception, match="no contents"):
        re.build_features(files, contents.where("path <> '2H.csv'"), str(tmp_path / "c"), CONFIG, batches=1)
    digests = files.select(F.col("relative_path").alias("path"), F.upper("sha256").alias("sha256"))
    assert re.altered_files(files, digests).count() == 0
    with pytest.raises(ValueError, match="SHA-256.*0L.csv"):
        re.build_features(files, contents, str(tmp_path / "d"), CONFIG, digests=digests.where("path <> '0L.csv'"))
    re.build_features(files, contents, str(tmp_path / "e"), CONFIG, batches=1, dataset={"version": "1"})
    with pytest.raises(ValueError, match="another configuration"):
        re.build_features(files, contents, str(tmp_path / "e"), CONFIG, batches=1, dataset={"version": "2"})


# ---- text


@pytest.fixture
def short_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def by_file(df):
    out = {}
    for r in df.orderBy("path", "n").collect():
        out.setdefault(r.path, []).append((r.n, r.x))
    assert all([n for n, _ in v] == list(range(len(v))) for v in out.values())
    return {k: [x for _, x in v] for k, v in out.items()}


def test_long_text_equals_short_text(spark, tmp_path, short_ranges):
    """Files over many ranges, cut anywhere, hold what numbers() reads from the whole text, at the same places."""
    rng = random.Random(8)
    value = lambda: rng.choice(["%d.000000" % rng.randint(-99999, 99999), repr(rng.gauss(0, 1)), "1e-3", "+7", " 5 ", "nan", "inf", "-Infinity"])
    texts = {f"a{i}.csv": ",".join(value() for _ in range(rng.choice([1, 10, 3000, 20_000]))) for i in range(6)}
    texts["trailing.csv"] = "1,2,3,\n"
    texts["header.csv"] = "time, value\n" + "1;2 3\t4,\n5" * 4000
    texts["long_header.csv"] = ",".join(f"c{i}" for i in range(9000)) + "\n" + ",".join(str(i) for i in range(9000))
    texts["numbers_first.csv"] = "nan,1\n2,3\n"
    texts["empty.csv"] = ""
    texts["blank.csv"] = " ,\n,"
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    got = by_file(lt.text_samples(spark, str(tmp_path), root=str(tmp_path)))
    want = {r.name: r.x for r in spark.createDataFrame(list(texts.items()), "name string, t string").select("name", rd.numbers(F.col("t")).alias("x")).collect()}
    assert set(got) == {k for k, v in want.items() if v}
    for name, x in got.items():
        assert np.array_equal(np.array(x), np.array(want[name]), equal_nan=True), name
    assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() >= 6
    blocks = lt.text_blocks(spark, str(tmp_path / "a0.csv"), root=str(tmp_path))
    assert blocks.groupBy().agg(F.sum(F.size("x"))).first()[0] == len(want["a0.csv"])


def test_long_text_by_lines(spark, tmp_path, short_ranges):
    (tmp_path / "rows.txt").write_text("a b\n" + "".join(f"{i} {i + 0.5}\n" for i in range(20_000)))
    (tmp_path / "column.txt").write_text("\n".join(str(i) for i in range(30_000)))
    got = by_file(lt.text_samples(spark, str(tmp_path), separator="\n", root=str(tmp_path)))
    assert got["rows.txt"] == [v for i in range(20_000) for v in (i, i + 0.5)] and got["column.txt"] == list(range(30_000))


@pytest.mark.parametrize("text", ["1,2,x,3", "1,2\n3,x", "a,b\n1,2\nc", "1,0x10", "1d,2", "1_0"])
def test_what_is_no_number(spark, tmp_path, text):
    (tmp_path / "f.csv").write_text(text)
    with pytest.raises(Exception, match="no number"):
        lt.text_samples(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no number"):
        spark.createDataFrame([(text,)], "t string").select(rd.numbers(F.col("t"))).collect()


def test_strict_text(spark, tmp_path, short_ranges):
    (tmp_path / "f.csv").write_text("".join(f"{i - 5000}.000000," for i in range(10_000)))
    assert by_file(lt.text_samples(spark, str(tmp_path), strict=True, root=str(tmp_path))) == {"f.csv": [i - 5000 for i in range(10_000)]}
    (tmp_path / "f.csv").write_text("1.000000,2.5")
    with pytest.raises(Exception, match="no number"):
        lt.text_samples(spark, str(tmp_path), strict=True).collect()


def test_one_line_files_keep_their_order(spark, tmp_path, short_ranges):
    s = spark.range(200_000).select(F.concat(F.lit("g"), F.col("id") % 3).alias("group_id"), F.lit("L").alias("part"), F.floor(F.col("id") / 3).alias("n"), F.xxhash64("id").cast("double").alias("x"))
    at = str(tmp_path / "out")
    sinks.write_one_line(s.orderBy(F.rand(1)), at)
    assert len(list((tmp_path / "out").glob("*/*/part-*"))) == 3
    got = lt.text_samples(spark, at, root=at, recursiveFileLookup=True).withColumn("group_id", F.regexp_extract("path", "=(g.)/", 1))
    assert got.join(s, ["group_id", "n", "x"]).count() == got.count() == 200_000

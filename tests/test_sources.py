"""Readers, sinks and streams on files of a temporary folder."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.sources import digests
from spectrel.sources import names as na
from spectrel.sources import readers as rd
from spectrel.sources import sinks
from spectrel.streaming import replay


@pytest.fixture
def folder(tmp_path):
    for sub in ("raw", "processed", "no_drone"):
        (tmp_path / sub).mkdir()
    (tmp_path / "raw/11000L_3.csv").write_text("-12.000000,5.000000,7.000000,")
    (tmp_path / "raw/11000H_3.csv").write_text("a b\n1.5 2\n3 4\n")
    (tmp_path / "processed/00000L_1.csv").write_text("1,2")
    (tmp_path / "signal_manifest.csv").write_text("x")
    (tmp_path / "no_drone/x.txt").write_text("1 2 3")
    (tmp_path / "notes.md").write_text("no signal")
    rng = np.random.default_rng(1)
    np.save(tmp_path / "raw/10000L_2.npy", rng.standard_normal((4, 8)))
    np.savez(tmp_path / "windows.npz", ventanas_l=rng.standard_normal((3, 16)).astype("f4"), ventanas_h=rng.standard_normal((3, 16)).astype("f4"), fs_hz=np.array([40e6]), preprocessed=np.array([1]), label=np.array([1]))
    np.savez(tmp_path / "plain.npz", a=rng.standard_normal(20), b=rng.standard_normal(50))
    return tmp_path


def test_manifest(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in na.manifest(na.signal_files(spark, str(folder))).collect()}
    assert set(got) == {"11000L_3.csv", "11000H_3.csv", "x.txt", "10000L_2.npy", "windows.npz", "plain.npz"}
    assert got["11000L_3.csv"].group_id == "rec_11000_3" and got["11000L_3.csv"].label == "target" and got["x.txt"].label == "background"
    assert got["10000L_2.npy"].part == "L" and got["windows.npz"].label == "unknown" and got["windows.npz"].code == ""


def test_text(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: list(r.x) for r in rd.read_text_signals(spark, [f"{folder}/raw/11000L_3.csv", f"{folder}/raw/11000H_3.csv"]).collect()}
    assert got == {"11000L_3.csv": [-12, 5, 7], "11000H_3.csv": [1.5, 2, 3, 4]}
    one = lambda v: spark.createDataFrame([(v,)], "v string").select(rd.strict_integers(F.col("v")).alias("x")).first().x
    assert one("1.000000,2.500000") is None and one("1234567.000000") is None and one("3.000000") == [3]
    with pytest.raises(Exception, match="no number"):
        spark.createDataFrame([("1,x",)], "v string").select(rd.numbers(F.col("v"))).collect()


def test_arrays(spark, folder):
    x = rd.read_arrays(spark, f"{folder}/raw/10000L_2.npy").first()
    assert list(x["shape"]) == [4, 8] and np.allclose(x.x, np.load(folder / "raw/10000L_2.npy").reshape(-1))
    parts = {r.part: r for r in rd.input_parts(rd.read_arrays(spark, f"{folder}/windows.npz")).collect()}
    assert set(parts) == {"L", "H"} and parts["L"].fs_hz == 40e6 and parts["L"].preprocessed and parts["L"].window_size == 16
    only = rd.input_parts(rd.read_arrays(spark, f"{folder}/plain.npz"), 1000.0).collect()
    assert [(r.part, len(r.x)) for r in only] == [("ONLY", 50)]
    with pytest.raises(Exception, match="sampling rate"):
        rd.input_parts(rd.read_arrays(spark, f"{folder}/plain.npz")).collect()


def test_dataset_manifest(spark, tmp_path):
    file = {"code": "11000", "activity": "target", "model": "phantom", "mode": "connected", "part": "L", "segment": 3, "group_id": "rec_11000_3", "partition": "dev", "relative_path": "a.csv", "sample_rate_hz": 40e6, "sha256": "00", "size_bytes": 10}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"status": "local_subset_ready", "files": [file, {**file, "part": "H", "relative_path": "b.csv"}]}, indent=1))
    files = rd.read_manifest(spark, str(path))
    assert files.count() == 2
    listing = spark.createDataFrame([("a.csv", 10)], "path string, size_bytes long")
    assert [r.relative_path for r in rd.missing_files(files, listing).collect()] == ["b.csv"]
    path.write_text(json.dumps({"status": "local_subset_ready", "files": [file, {k: v for k, v in file.items() if k != "sha256"}]}))
    with pytest.raises(ValueError, match="lack fields"):
        rd.read_manifest(spark, str(path))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("g", "L", 1, 0.5, "dev"), ("g", "H", 2, 0.7, "eval")], "group_id string, part string, window_id long, rms double, partition string")
    sinks.write_features(rows, str(tmp_path / "f"))
    sinks.write_features(rows.where("partition = 'eval'").withColumn("rms", F.lit(9.0)), str(tmp_path / "f"))
    assert {(r.partition, r.rms) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {("dev", 0.5), ("eval", 9.0)}
    with pytest.raises(ValueError, match="labels away"):
        sinks.write_package(rows.withColumn("label", F.lit("x")), str(tmp_path / "p"), rows, str(tmp_path / "c"))
    sinks.save_parameters(spark, {"threshold": 0.5}, str(tmp_path / "b"))
    assert sinks.load_parameters(spark, str(tmp_path / "b"), ["threshold"])["threshold"] == 0.5
    with pytest.raises(ValueError, match="lacks"):
        sinks.load_parameters(spark, str(tmp_path / "b"), ["guard"])
    assert all(len(r.sha256) == 64 for r in sinks.registry(spark, str(tmp_path / "b")).collect())
    assert set(sinks.run_facts()) == {"at", "python", "pyspark", "commit"}


def test_feature_tables_from_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("window_id,rms,part\n1,0.5,L\n2,,H\n")
    got = rd.read_features(spark, str(tmp_path / "f.csv"), "window_id long, rms double, part string").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, "L"), (2, None, "H")]


def test_stream_of_running_medians(spark, tmp_path):
    rows = [("g", "L", i, float(i)) for i in range(30)] + [("g", "H", i, 1.0) for i in range(10)]
    schema = "group_id string, part string, idx long, score double"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 10 == k] or rows[:0], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay.replay(replay.running_medians(stream), lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = {(r.part): r for r in sorted(seen, key=lambda r: r.seen)}
    assert last["L"].seen == 30 and last["L"].median == 14.5 and last["H"].seen == 10
    batch = replay.progressive_scores(spark.createDataFrame(rows, schema)).orderBy("stop").collect()
    assert [(r.stop, r.score, r.parts_used) for r in batch] == [(10, 2.75, 2), (20, 9.5, 1), (30, 14.5, 1)]


def test_stream_of_event_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ev")).schema).parquet(str(tmp_path / "ev"))
    q = replay.event_windows(stream).writeStream.format("memory").queryName("ev").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r)[:3] for r in replay.event_windows(events).collect()}
    assert {tuple(r)[:3] for r in spark.table("ev").collect()} == want


def mat_file(arrays, compress):
    """A level-5 MAT file of real and complex arrays."""
    import struct
    import zlib

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    kinds = {"f8": (6, 9), "f4": (7, 7), "i2": (10, 3), "u1": (9, 2)}
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, a in arrays.items():
        cls, kind = kinds[a.real.dtype.str[1:]]
        body = element(6, struct.pack("<II", cls | (0x800 if np.iscomplexobj(a) else 0), 0)) + element(5, struct.pack(f"<{a.ndim}i", *a.shape)) + element(1, name.encode())
        for part in [a.real, a.imag] if np.iscomplexobj(a) else [a]:
            body += element(kind, np.asfortranarray(part).tobytes(order="F"))
        whole = element(14, body)
        out += struct.pack("<II", 15, len(z := zlib.compress(whole))) + z if compress else whole
    return out


@pytest.mark.parametrize("compress", [False, True])
def test_mat_files(spark, tmp_path, compress):
    rng = np.random.default_rng(2)
    arrays = {"signal": rng.standard_normal((5, 7)), "short": np.arange(6, dtype="i2").reshape(2, 3), "z": rng.standard_normal((4, 1)) + 1j * rng.standard_normal((4, 1)), "single": rng.standard_normal((3, 3)).astype("f4"), "__hidden": np.zeros((9, 9))}
    (tmp_path / "x.mat").write_bytes(mat_file(arrays, compress))
    got = {r["name"]: r for r in rd.read_arrays(spark, str(tmp_path / "x.mat")).collect()}
    assert set(got) == {"signal", "short", "z", "single"}
    for name, r in got.items():
        assert list(r["shape"]) == list(arrays[name].shape) and np.allclose(r.x, arrays[name].real.reshape(-1)) and (r.im is None or np.allclose(r.im, arrays[name].imag.reshape(-1)))
    only = rd.input_parts(rd.read_arrays(spark, str(tmp_path / "x.mat")).where("size(x) > 16"), 10.0).collect()
    assert [(r.part, len(r.x)) for r in only] == [("ONLY", 35)]


def test_iq_signals(spark, tmp_path):
    a = np.arange(12.0)
    np.savez(tmp_path / "iq.npz", columns=a.reshape(6, 2), rows=a.reshape(2, 6), plain=a.reshape(3, 4))
    got = {r["name"]: (r.x, r.im) for r in rd.iq_signals(rd.read_arrays(spark, str(tmp_path / "iq.npz"))).collect()}
    assert got["columns"] == (list(a[::2]), list(a[1::2])) and got["rows"] == (list(a[:6]), list(a[6:])) and got["plain"] == (list(a), None)


def test_run_manifest(spark, tmp_path):
    sinks.write_json(spark.range(3), str(tmp_path / "t"))
    got = sinks.write_run_manifest(spark, str(tmp_path / "m"), "r1", "done", {"windows": 3}, [str(tmp_path / "t")])
    back = json.loads(spark.read.text(str(tmp_path / "m")).first()[0])
    assert back == json.loads(json.dumps(got)) and back["counts"] == {"windows": 3} and back["environment"]["pyspark"]["ready"]
    files = spark.read.json(str(tmp_path / "m-artifacts")).collect()
    assert back["artifacts"]["files"] == len(files) > 0 and back["artifacts"]["size_bytes"] == sum(f.size_bytes for f in files)
    assert all(hashlib.sha256(open(f.path.removeprefix("file:"), "rb").read()).hexdigest() == f.sha256 for f in files)


def test_environment():
    assert sinks.check_environment()["numpy"]["there"] and sinks.at_least("4.10.1", "4.9") and not sinks.at_least("4.0.9", "4.1")
    with pytest.raises(OSError, match="numpy .*needs 99.*nothing_there missing"):
        sinks.check_environment({"numpy": "99", "nothing_there": "1"})


def test_digests_of_large_files(spark, tmp_path):
    """Files beyond the limit are streamed; a sparse file of 3 GB goes beyond what a row can hold."""
    (tmp_path / "a").write_bytes(b"x" * 100)
    (tmp_path / "b").write_bytes(b"y" * 5000)
    with open(tmp_path / "c", "wb") as f:
        f.truncate(3 << 30)
    got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in digests.file_digests(spark, str(tmp_path), 1000).collect()}
    zero = hashlib.sha256()
    for _ in range(3 << 10):
        zero.update(bytes(1 << 20))
    assert got == {"a": (100, hashlib.sha256(b"x" * 100).hexdigest()), "b": (5000, hashlib.sha256(b"y" * 5000).hexdigest()), "c": (3 << 30, zero.hexdigest())}

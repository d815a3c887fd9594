"""ZIP archives as a source."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spectrel.operators import recordings as re
from spectrel.plans import audits as au
from spectrel.sources import archives as ar
from spectrel.sources import sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("zips")
    rng = random.Random(1)
    texts = {"raw/a.csv": ",".join(str(rng.randint(-9, 9)) for _ in range(50_000)), "raw/b.csv": "t,v\n1.5,nan\n3,4", "raw/empty.csv": "", "notes.md": "no numbers"}
    (at / "sub").mkdir()
    for name, kind in (("one.zip", zipfile.ZIP_DEFLATED), ("sub/two.ZIP", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(at / name, "w", kind) as z:
            z.writestr(zipfile.ZipInfo("raw/"), "")
            for k, t in texts.items():
                z.writestr(k, t + ("" if name == "one.zip" or k != "raw/a.csv" else ",5"))
    (at / ".hidden.zip").write_bytes(b"no archive")
    (at / "other.txt").write_text("no archive")
    return at, texts


def test_members_and_chunks(spark, folder):
    at, texts = folder
    rows = ar.read_zip(spark, str(at), chunkBytes=1000, partitionBytes=2000).orderBy("archive", "member", "offset").collect()
    whole = {}
    for r in rows:
        key = r.archive.rsplit("/", 1)[1], r.member
        assert r.offset == len(whole.get(key, b"")) and len(r.content) <= 1000
        whole[key] = whole.get(key, b"") + r.content
    assert len(whole) == 8 and all(whole["one.zip", k] == t.encode() for k, t in texts.items())
    assert {r.member for r in ar.read_zip(spark, str(at / "one.zip"), pattern=r"\.csv$").collect()} == {"raw/a.csv", "raw/b.csv", "raw/empty.csv"}
    listing = ar.zip_listing(spark, str(at / "one.zip")).collect()
    assert {r.member: r.size_bytes for r in listing} == {k: len(t) for k, t in texts.items()}
    digests = {r.path: r.sha256 for r in ar.zip_digests(spark, str(at / "one.zip")).collect()}
    assert digests == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}


def test_partitions_follow_the_directory(folder):
    at, _ = folder
    reader = ar.ZipReader({"path": str(at), "partitionbytes": "1"})
    assert [(p.archive.rsplit("/", 1)[1], p.first, p.last) for p in reader.partitions()] == [(z, i, i + 1) for z in ("one.zip", "two.ZIP") for i in range(4)]
    assert len(ar.ZipReader({"path": str(at)}).partitions()) == 2
    assert list(ar.ZipReader({"path": str(at), "pattern": "nothing"}).read(ar.ZipReader({"path": str(at), "pattern": "nothing"}).partitions()[0])) == []
    cut = ar.ZipReader({"path": str(at), "cut": ",", "chunkbytes": "7"})
    with zipfile.ZipFile(at / "one.zip") as z:
        got = list(cut.chunks(z, z.getinfo("raw/a.csv")))
    assert all(c.endswith(b",") for _, c in got[:-1]) and [o for o, _ in got] == [sum(len(c) for _, c in got[:i]) for i in range(len(got))]


def test_samples_of_members(spark, folder):
    at, texts = folder
    s = ar.zip_samples(spark, str(at), pattern=r"\.csv$", chunkBytes=900)
    got = {}
    for r in s.where("archive like '%one.zip'").orderBy("member", "n").collect():
        got.setdefault(r.member, []).append((r.n, r.x))
    assert got["raw/a.csv"] == list(enumerate(float(v) for v in texts["raw/a.csv"].split(",")))
    assert [(n, str(x)) for n, x in got["raw/b.csv"]] == [(0, "1.5"), (1, "nan"), (2, "3.0"), (3, "4.0")] and set(got) == {"raw/a.csv", "raw/b.csv"}
    assert s.where("archive like '%two.ZIP' and member = 'raw/a.csv'").count() == 50_001
    with pytest.raises(Exception, match="no number"):
        ar.zip_samples(spark, str(at)).collect()


def test_a_damaged_member_is_an_error(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.csv", "1,2,3,4,5,6,7,8,9")
    data = bytearray(buffer.getvalue())
    data[data.index(b"5,6")] = ord("7")
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="CRC"):
        ar.zip_samples(spark, str(tmp_path / "bad.zip")).collect()


def test_written_archives(spark, tmp_path):
    rows = [(f"z{i % 3}", f"m{i}.txt", f"content {i}\n" * i) for i in range(30)]
    out = sinks.write_zips(spark.createDataFrame(rows, "archive string, member string, content string"), str(tmp_path / "out")).collect()
    assert {(r.archive, r.members) for r in out} == {("z0", 10), ("z1", 10), ("z2", 10)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["z0.zip", "z1.zip", "z2.zip"]
    with zipfile.ZipFile(tmp_path / "out/z1.zip") as z:
        assert {n: z.read(n).decode() for n in z.namelist()} == {m: c for a, m, c in rows if a == "z1"}


def test_features_from_archives_equal_those_from_files(spark, small):
    files, text = au.recorded(spark, small)
    s = ar.zip_samples(spark, au.zipped(spark, small)).select(F.col("member").alias("path"), "n", "x")
    a, b = (re.file_features(files, c, au.CONFIG).select("window_id", "start", *au.FEATURES4) for c in (text, s))
    a, b = ({r.window_id: tuple(r)[1:] for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and all(abs(u - v) <= 1e-9 * max(1, abs(u)) for k in a for u, v in zip(a[k], b[k], strict=True))
    digests = ar.zip_digests(spark, au.zipped(spark, small)).select("path", "sha256")
    known = files.drop("sha256").join(digests.withColumnRenamed("path", "relative_path"), "relative_path") if "sha256" in files.columns else files.join(digests.withColumnRenamed("path", "relative_path"), "relative_path")
    assert re.altered_files(known, digests).count() == 0 and known.count() == files.count()
    assert re.altered_files(known.withColumn("sha256", F.lit("0")), digests).count() == files.count()

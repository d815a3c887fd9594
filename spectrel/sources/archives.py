"""Members of ZIP archives as a source: nothing is unpacked to disk.

The archives' directories tell which members there are; members that lie one after the other go to one partition up to a number of compressed bytes, a
larger one alone. A task inflates its members as streams, in chunks of bounded size, which can be cut after a separator so that no number is torn. Checksums are those of the
archive: a member that doesn't fit its checksum is an error.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spectrel.functions.tables import written
from spectrel.sources.longtext import FACTS, chunk_batch, chunk_row, parse_bytes, placed, samples

SCHEMA = "archive string, member string, size_bytes long, crc long, offset long, content binary"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI that Arrow reaches (local, HDFS, S3, GCS), and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def archive_paths(path: str) -> list[str]:
    """The archive, or the archives of a folder and its folders, by name; hidden files are passed over."""
    fs, at = located(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [path]
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and f.path.lower().endswith(".zip") and not f.base_name.startswith(".")]
    return sorted(path.rstrip("/") + f[len(at.rstrip("/")) :] for f in found)


def members(archive: str, pattern: str) -> list[zipfile.ZipInfo]:
    fs, at = located(archive)
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        return [m for m in z.infolist() if not m.is_dir() and re.search(pattern, m.filename)]


class Members(InputPartition):
    """The members from the `first` to before the `last` of those that fit the pattern."""

    def __init__(self, archive: str, first: int, last: int):
        self.archive, self.first, self.last = archive, first, last


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.cut = options["path"], options.get("pattern", ""), options.get("cut", "").encode()
        self.contents = options.get("contents", "true").lower() == "true"
        self.chunk, self.target = int(options.get("chunkbytes", 4 << 20)), int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Members]:
        out = []
        for archive in archive_paths(self.path):
            first, size = 0, 0
            all_ = members(archive, self.pattern)
            for i, m in enumerate(all_):
                if i > first and size + m.compress_size > self.target:
                    out.append(Members(archive, first, i))
                    first, size = i, 0
                size += m.compress_size
            if all_:
                out.append(Members(archive, first, len(all_)))
        return out or [Members("", 0, 0)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        fs, at = located(partition.archive)
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            some = [m for m in z.infolist() if not m.is_dir() and re.search(self.pattern, m.filename)][partition.first : partition.last]
            for m in some:
                for offset, content in self.chunks(z, m) if self.contents else [(0, None)]:
                    row = {"archive": partition.archive, "member": m.filename, "size_bytes": m.file_size, "crc": m.CRC, "offset": offset, "content": content}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("archive", pa.string()), ("member", pa.string()), ("size_bytes", pa.int64()), ("crc", pa.int64()), ("offset", pa.int64()), ("content", pa.binary())]))

    def chunks(self, z: zipfile.ZipFile, m: zipfile.ZipInfo) -> Iterator[tuple[int, bytes]]:
        """(offset, bytes) of a member; an empty one has one empty chunk."""
        offset, rest = 0, b""
        with z.open(m) as stream:
            while more := stream.read(self.chunk):
                whole = rest + more
                end = whole.rfind(self.cut) + len(self.cut) if self.cut else len(whole)
                if end <= 0 or self.cut and whole.rfind(self.cut) < 0:
                    rest = whole
                    continue
                yield offset, whole[:end]
                offset, rest = offset + end, whole[end:]
        if rest or not offset:
            yield offset, rest


class ZipMembers(DataSource):
    """spark.read.format("zip_members").load(path): archive, member, size_bytes, crc, offset and content of the members of a ZIP file, or of all
    in a folder. Options: pattern (of names), cut (a separator after which chunks end), chunkBytes, partitionBytes (compressed), contents (false: a row a member
    with a null content, from the directory alone)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def read_zip(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(**options).load(path)


def zip_listing(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(archive, member, size_bytes, crc) from the archives' directories; nothing is inflated."""
    return read_zip(spark, path, pattern=pattern, contents="false").select("archive", "member", "size_bytes", "crc")


def zip_digests(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(archive, path, size_bytes, sha256) of every member, streamed: chunks of a member come one after the other in a task."""

    def run(batches):
        import hashlib

        at, digest, size = None, None, 0
        for b in batches:
            for archive, member, content in zip(*(b.column(c).to_pylist() for c in ("archive", "member", "content")), strict=True):
                if (archive, member) != at:
                    if at:
                        yield pa.RecordBatch.from_pylist([{"archive": at[0], "path": at[1], "size_bytes": size, "sha256": digest.hexdigest()}])
                    at, digest, size = (archive, member), hashlib.sha256(), 0
                digest.update(content)
                size += len(content)
        if at:
            yield pa.RecordBatch.from_pylist([{"archive": at[0], "path": at[1], "size_bytes": size, "sha256": digest.hexdigest()}])

    return read_zip(spark, path, pattern=pattern).select("archive", "member", "content").mapInArrow(run, "archive string, path string, size_bytes long, sha256 string")


def zip_samples(spark: SparkSession, path: str, pattern: str = "", separator: str = ",", strict: bool = False, **options) -> DataFrame:
    """(archive, member, n, x): the numbers of the members that are texts, as longtext reads files. separator: one that comes often, where chunks may end."""
    raw = read_zip(spark, path, pattern=pattern, cut=separator, **options)

    def run(batches):
        at, seen = None, 0
        for b in batches:
            rows, names = [], []
            for file, archive, member, content in zip(*(b.column(c).to_pylist() for c in ("file", "archive", "member", "content")), strict=True):
                seen = seen if (archive, member) == at else 0
                names.append((archive, member) if (archive, member) != at else (None, None))
                at = (archive, member)
                x, head, bad = parse_bytes(content, strict)
                rows.append(chunk_row(file, 0, seen, x, head, bad))
                seen += len(x)
            if rows:
                got = chunk_batch(rows)
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array([a for a, _ in names], pa.string()), pa.array([m for _, m in names], pa.string())], names=[*got.schema.names, "archive", "member"])

    ids = raw.select(F.xxhash64("archive", "member").alias("file"), "archive", "member", "content")
    chunks = written(ids.mapInArrow(run, f"{FACTS}, x array<double>, archive string, member string"), "members")
    names = chunks.where("member is not null").select("file", "archive", "member")
    return samples(placed(chunks.drop("archive", "member")).join(names, "file").select("archive", "member", "start", "x"))

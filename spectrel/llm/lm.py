"""Stupid-backoff language-model scores.

Documents are gathered in blocks where they are read, by bytes, so that a block holds neighbouring rows and no key decides who shares
one; blocks are written once, with their texts compressed. A block explodes its documents into n-grams of every order and gives, for each
order and range of hashes, the distinct n-grams with their numbers. These meet by order and range, where the count tables are made:
summed over all blocks, and pruned below a least count. Every block gets the counts of its own n-grams back (the join of the exploded
n-grams with the count tables), looks them up for every place of its documents, and sums the log scores up for each document. N-grams are
known by as many bits of hash as a range's number has and 46 more, 64 at most, sent as differences of neighbours in their order.

The score of a word after two others: count(abc) / count(ab) if abc is in the table, else backoff * count(bc) / count(b) if bc is,
else backoff squared * count(c) / words of the corpus; the first words of a document have the shorter contexts that there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm.common import LOWER_AZ, UPPER_AZ, WORD_PATTERN, Shelf, WordHashes, alnum_words, free_name, gram_hashes, read, steps, text_bytes


@dataclass(frozen=True)
class LmRule:
    """order: of the longest n-grams. least: occurrences that an n-gram of two or more words needs to be in the tables. backoff: factor for each
    shorter context. block: bytes of text in a block. range_: n-grams in a range of hashes, about."""

    order: int = 3
    least: int = 2
    backoff: float = 0.4
    block: int = 8 << 20
    range_: int = 2_000_000


#: Bits of an n-gram's hash besides those that name its range.
REST = 46


def pack(n: np.ndarray) -> bytes:
    """Counts: a byte each, and those of 255 or more in full behind, compressed."""
    small = np.minimum(n, 255).astype(np.uint8)
    data = small.tobytes() + n[small == 255].astype(np.int64).tobytes()
    return len(n).to_bytes(8, "little") + len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[16:], int.from_bytes(data[8:16], "little"), asbytes=True)
    out = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], dtype=np.int64)
    return out


def pack_texts(texts: list[bytes | None]) -> bytes:
    """Texts (null as empty) as compressed bytes."""
    whole = [t or b"" for t in texts]
    data = np.array([len(whole), *map(len, whole)], dtype=np.int64).tobytes() + b"".join(whole)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(data, asbytes=True)


def unpack_texts(data: bytes) -> list[bytes]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, dtype=np.int64, offset=8, count=n)) + 8 * (n + 1)
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


class Block:
    """The n-grams of a block's documents."""

    def __init__(self, texts: list[bytes], bits: int):
        known, hashes = WordHashes(), []
        for t in texts:
            hashes.append(known.of(alnum_words(t)))
        self.lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        self.hashes = hashes
        self.drop = np.uint64(64 - width_of(bits))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the n-gram of k words at every place, all documents one after the other."""
        return np.concatenate([gram_hashes(h, k) for h in self.hashes] or [np.empty(0, dtype=np.uint64)]) >> self.drop


def width_of(bits: int) -> int:
    """Bits by which n-grams are known where a range's number has so many."""
    return min(64, bits + REST)


def split_ranges(distinct: np.ndarray, bits: int):
    """(range, start, end) of sorted hashes; the upper bits name the range."""
    which = (distinct >> np.uint64(width_of(bits) - bits)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(which) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(which[a]), int(a), int(b)


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes of a range: the first, then the differences, their lower 4 bytes one after the other and then what is above: half a byte each, and
    the few that need more with their places; or 2 bytes each where many do."""
    step = np.diff(h)
    upper = (step >> np.uint64(32)).astype(np.uint16)
    more = np.flatnonzero(upper > 15).astype(np.uint32)
    head = h[:1].tobytes() + len(step).to_bytes(4, "little") + (step & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
    if 8 * len(more) > len(step):
        return b"\1" + head + upper.tobytes()
    half = np.r_[upper & 15, np.zeros(len(upper) % 2, dtype=np.uint16)].astype(np.uint8)
    return b"\0" + head + (half[::2] | half[1::2] << 4).tobytes() + more.tobytes() + upper[more].tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[9:13], "little")
    lower, rest = np.frombuffer(data, dtype=np.uint32, offset=13, count=n).astype(np.uint64), data[13 + 4 * n :]
    if data[0]:
        upper = np.frombuffer(rest, dtype=np.uint16)
    else:
        packed = np.frombuffer(rest, dtype=np.uint8, count=(n + 1) // 2)
        upper = np.stack([packed & 15, packed >> 4], axis=1).reshape(-1)[:n].astype(np.uint16)
        rest = rest[len(packed) :]
        count = len(rest) // 6
        upper[np.frombuffer(rest, dtype=np.uint32, count=count)] = np.frombuffer(rest[4 * count :], dtype=np.uint16)
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = int.from_bytes(data[1:9], "little")
    out[1:] = lower | upper.astype(np.uint64) << np.uint64(32)
    return np.cumsum(out, dtype=np.uint64)


def place_scores(counts: list[np.ndarray], lengths: np.ndarray, rule: LmRule) -> tuple[np.ndarray, np.ndarray]:
    """By document: the sum of log scores but for the corpus's number of words, and how many words were scored by their own count.

    counts: by order, of the n-gram at every place (0: not in the table)."""
    n = int(lengths.sum())
    log = [np.log(np.maximum(c, 1)) for c in counts]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    score, left = np.zeros(n), np.ones(n, dtype=bool)
    factor = np.zeros(n)
    for k in range(rule.order, 1, -1):
        # the place of a word's k-gram and of its first k - 1 words among the n-grams of their order
        has = at >= k - 1
        lost = lambda m: np.repeat(np.cumsum(np.minimum(lengths, m)) - np.minimum(lengths, m), lengths)
        i = (np.arange(n) - lost(k - 1) - (k - 1))[has]
        context = (np.arange(n) - lost(k - 2) - (k - 1))[has]
        full = counts[k - 1][i]
        hit = np.zeros(n, dtype=bool)
        hit[has] = full > 0
        hit &= left
        value = np.zeros(n)
        value[has] = log[k - 1][i] - log[k - 2][context]
        score[hit] = value[hit] + factor[hit]
        left &= ~hit
        factor[left & has] += np.log(rule.backoff)
    score[left] = log[0][left] + factor[left]
    size = len(lengths)
    return np.bincount(doc, weights=score, minlength=size).astype(float), np.bincount(doc[left], minlength=size)


def blocks_of(docs: DataFrame, row: str, text: str, size: int) -> DataFrame:
    """docs as blocks of about `size` bytes of text: block, at (the row's number in it), row (a struct), and with the first row the block's
    texts. Rows that are read together stand together, a longer text stands alone."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()), docs.schema[row], T.StructField("texts", T.BinaryType())])

    def run(batches):
        first, held, bytes_ = TaskContext.get().partitionId() << 32, [], 0

        def made():
            nonlocal first, held, bytes_
            rows = pa.concat_arrays([b.column(row) for b in held])
            data = pack_texts([t for b in held for t in text_bytes(b.column(text)).to_pylist()])
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), first)), pa.array(np.arange(len(rows), dtype=np.int32)), rows, pa.array([data] + [None] * (len(rows) - 1), pa.binary())], names=["block", "at", row, "texts"])
            first, held, bytes_ = first + 1, [], 0
            return out

        for whole in batches:
            for b in steps(whole, text, size // 4):
                n = text_bytes(b.column(text)).nbytes
                if held and bytes_ + n > size:
                    yield made()
                held.append(b)
                bytes_ += n
        if held:
            yield made()

    return docs.select(row, text).mapInArrow(run, schema)


def backoff_scores(docs: DataFrame, rule: LmRule = LmRule(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep), n_words, total (the sum of the words' log scores, natural) and score (per word).

    The model is that of all documents of docs. A null or empty text, or one without words, has total 0 and a null score. Repeated rows count and
    are scored each. Columns of docs with the names of new ones are replaced. An empty table gives an empty table.
    """
    shelf = Shelf(docs.sparkSession, "lm")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "score", "total")]
    bytes_ = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    bits = max(1, int(bytes_ // 2 // rule.range_).bit_length())
    order = rule.order
    row, plain = free_name(docs, "row", "plain")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(row), F.col(f"`{text}`").cast("string").alias(plain))
    blocks = shelf.put(blocks_of(source, row, plain, rule.block))

    def explode(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
                made = Block(unpack_texts(data.as_py()), bits)
                for k in range(order):
                    distinct, n = np.unique(made.grams(k + 1), return_counts=True)
                    out = [(r, pack_hashes(distinct[a:b]), pack(n[a:b])) for r, a, b in split_ranges(distinct, bits)]
                    cols = list(zip(*out, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([k] * len(out), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["block", "k", "part", "grams", "n"])

    def count(table: pa.Table) -> pa.Table:
        sizes, n = [], []
        for x in table.column("n"):
            n.append(unpack(x.as_py()))
            sizes.append(len(n[-1]))
        every, at = np.empty(sum(sizes), dtype=np.uint64), 0
        for x, size in zip(table.column("grams"), sizes, strict=True):
            every[at : at + size] = unpack_hashes(x.as_py())
            at += size
        distinct, at = np.unique(every, return_inverse=True)
        del every
        sums = np.bincount(at, weights=np.concatenate(n), minlength=len(distinct)).astype(np.int64)
        if table.column("k")[0].as_py() > 0:
            sums[sums < rule.least] = 0
        ends = np.cumsum(sizes)
        counts = [pack(sums[at[e - s : e]]) for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"block": table.column("block"), "k": table.column("k"), "part": table.column("part"), "n": pa.array(counts, pa.binary())})

    out_schema = T.StructType([blocks.schema[row], T.StructField("n_words", T.LongType()), T.StructField("part_score", T.DoubleType()), T.StructField("own", T.LongType())])

    def score(mine: pa.Table, counts: pa.Table) -> pa.Table:
        mine = mine.sort_by("at")
        made = Block(unpack_texts(mine.column("texts")[0].as_py()) if mine.num_rows else [], bits)
        held: dict[int, list[tuple[int, bytes]]] = {}
        for k, r, n in zip(counts.column("k").to_pylist(), counts.column("part").to_pylist(), counts.column("n").to_pylist(), strict=True):
            held.setdefault(k, []).append((r, n))
        looked = []
        for k in range(order):
            g = made.grams(k + 1)
            at = np.unique(g, return_inverse=True)[1]
            table = np.concatenate([unpack(n) for _, n in sorted(held.pop(k, []))] or [np.empty(0, dtype=np.int64)])
            looked.append(table[at] if len(g) else np.empty(0, dtype=np.int64))
        parts, own = place_scores(looked, made.lengths, rule)
        return pa.table({row: mine.column(row), "n_words": made.lengths, "part_score": parts, "own": own.astype(np.int64)})

    exploded = blocks.where("texts is not null").select("block", "texts").mapInArrow(explode, "block long, k int, part int, grams binary, n binary")
    counts = exploded.groupBy("k", "part").applyInArrow(count, "block long, k int, part int, n binary")
    scored = shelf.put(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(score, out_schema))
    shelf.drop(blocks)
    words = scored.agg(F.sum("n_words")).first()[0] or 0
    final = F.col("part_score") - F.col("own") * float(np.log(max(1, words)))
    return scored.select(f"{row}.*", "n_words", final.alias("total"), F.when(F.col("n_words") > 0, final / F.col("n_words")).alias("score"))


def op4_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backoff_scores() over all documents, doc_id only, rounded to 6 places; edge cases as defined there."""
    out = backoff_scores(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", F.round("total", 6).alias("total"), F.round("score", 6).alias("score"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '{WORD_PATTERN}') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS c, w[i - 1] AS b, w[i - 2] AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS MATERIALIZED (SELECT doc_id, c, CASE WHEN i > 1 THEN b END AS b, CASE WHEN i > 2 THEN a END AS a FROM t),
c1 AS MATERIALIZED (SELECT c, count(*) AS n FROM g GROUP BY c),
c2 AS MATERIALIZED (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c HAVING count(*) >= 2),
c3 AS MATERIALIZED (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
s AS (
  SELECT g.doc_id, CASE
    WHEN c3.n IS NOT NULL THEN ln(c3.n) - ln(ab.n)
    WHEN c2.n IS NOT NULL THEN ln(c2.n) - ln(b1.n) + CASE WHEN g.a IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END
    ELSE ln(c1.n) - ln((SELECT count(*) FROM g)) + ln(0.4::DOUBLE) * (CASE WHEN g.a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN g.b IS NOT NULL THEN 1 ELSE 0 END)
  END AS x
  FROM g JOIN c1 ON g.c = c1.c LEFT JOIN c2 ON g.b = c2.b AND g.c = c2.c LEFT JOIN c3 ON g.a = c3.a AND g.b = c3.b AND g.c = c3.c
    LEFT JOIN c1 AS b1 ON g.b = b1.c LEFT JOIN c2 AS ab ON g.a = ab.b AND g.b = ab.c)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(x.x, 0), 6) AS total, round(x.x / len(d.w), 6) AS score
FROM d LEFT JOIN (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id) x ON d.doc_id = x.doc_id
"""

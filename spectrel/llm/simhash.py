"""SimHash near-duplicate groups by anchor-point covering.

A fingerprint's bits are cut into pieces of at most 23. The anchors of a piece are the words of the perfect binary Golay code, whose
covering radius is 3: no word is further than 3 from an anchor. A block is one piece or two; its anchors are the pairs of its pieces'
anchors, 2^24 for two. If two fingerprints differ in at most t bits, they do in at most t_b bits of some block (which is verified for
every way to spread t bits over the pieces), and of a word halfway between them each piece lies within 3 of an anchor. Both
fingerprints are therefore within 3 + x of that anchor in the first piece and 3 + y in the second, with x + y at most ceil(t_b / 2).
Every distinct fingerprint is replicated to all anchors within covering radius plus half the threshold, and compared with those at the
same anchor only. Anchors with many fingerprints are dealt out as cells of two slices each. What an anchor (or cell) gives are stars,
one row for each fingerprint that has a partner, whatever the size of its group; components() joins them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm.common import Shelf, free_name, mix, per_text, read, space_words, steps, text_bytes
from spectrel.llm.components import components

#: Shingles whose bits are counted together.
CHUNK = 1 << 16


#: (first bit, bits) of the pieces of a fingerprint.
PIECES = ((0, 23), (23, 23), (46, 18))


@dataclass(frozen=True)
class SimHashRule:
    """shingle: words in a shingle. threshold: bits in which linked fingerprints may differ. blocks: (pieces, threshold of the block),
    a piece by its first bit and bits. wide: None, or the most bits in which a second fingerprint of 192 bits may differ for a link.
    cell: fingerprints of an anchor that are compared in one task; beyond it the anchor is dealt out as cells."""

    shingle: int = 3
    threshold: int = 3
    blocks: tuple = (((PIECES[0], PIECES[1]), 2), ((PIECES[0], PIECES[2]), 1), ((PIECES[1], PIECES[2]), 1))
    wide: int | None = None
    cell: int = 8192

    def __post_init__(self):
        pieces = sorted({p for block, _ in self.blocks for p in block})
        ends = [first + bits for first, bits in pieces]
        if any(bits > 23 for _, bits in pieces) or any(len(block) not in (1, 2) for block, _ in self.blocks) or any(e > p[0] for e, p in zip(ends, pieces[1:], strict=False)):
            raise ValueError("a block has one or two pieces of at most 23 bits, and pieces don't overlap")
        for spread in product(range(self.threshold + 1), repeat=len(pieces)):
            if sum(spread) <= self.threshold and not any(sum(spread[pieces.index(p)] for p in block) <= t for block, t in self.blocks):
                raise ValueError("the blocks' thresholds don't cover the threshold")


#: Near copies by fingerprints alone: five words, and a similarity of about 0.8. Fingerprints of 64 bits that agree in 0.8 of their bits
#: differ in 12 at most, and the 256 bits of both fingerprints must put the Jaccard similarity at 0.8 (a cosine of 8/9, an angle of
#: 0.476, 38.8 bits; 29 of the 192 bits). An estimate for tables of moderate size: so wide a threshold puts most pairs to the test.
NEAR = SimHashRule(5, 12, (((PIECES[0],), 4), ((PIECES[1],), 3), ((PIECES[2],), 3)), wide=29)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, from the highest."""
    out = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        out += np.unpackbits(h[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return out


def majority(h: np.ndarray) -> int:
    return int.from_bytes(np.packbits(2 * bit_counts(h) > len(h)).tobytes(), "big")


def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of n words, repeats included; of all words if there are fewer."""
    w = space_words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    made = map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in made), dtype=np.uint64, count=max(1, len(w) - n + 1))


def fingerprints(docs: DataFrame, rule: SimHashRule, text: str, name: str, wide: str | None, keep: list[str]) -> DataFrame:
    """keep's columns and the fingerprint of every whole text as a signed 64-bit integer (0: no words), and if wide is given, 24 more bytes."""

    def make():
        def do(texts):
            fp, more = [], []
            for t in texts:
                h = shingle_hashes(t, rule.shingle)
                fp.append(majority(h))
                if wide:
                    more.append(b"".join(majority(h := mix(h + np.uint64(0x9E3779B97F4A7C15))).to_bytes(8, "little") for _ in range(3)))
            return [np.array(fp, dtype=np.uint64).view(np.int64), *[more] * bool(wide)]

        return do

    return per_text(docs, text, [(name, T.LongType()), *[(wide, T.BinaryType())] * bool(wide)], make, keep)


@cache
def golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """The parity bits (11) of each message (12 bits) of the Golay code, and for r from 0 to 2 the error words of up to 3 + r bits by syndrome, as a table padded with -1."""
    poly = 0b110001110101
    parity = np.zeros(4096, dtype=np.int64)
    for m in range(4096):
        r = m << 11
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= poly << (i - 11)
        parity[m] = r
    bits = 1 << np.arange(23, dtype=np.int64)
    words, tables = [np.zeros(1, dtype=np.int64)], []
    tops = [np.full(1, -1)]
    for _ in range(5):
        w, t = words[-1], tops[-1]
        pick = np.arange(23)[None] > t[:, None]
        words.append((w[:, None] | bits[None])[pick])
        tops.append(np.broadcast_to(np.arange(23), pick.shape)[pick])
    for most in (3, 4, 5):
        e = np.concatenate(words[: most + 1])
        syn = parity[e >> 11] ^ (e & 2047)
        order = np.argsort(syn, kind="stable")
        e, syn = e[order], syn[order]
        start = np.searchsorted(syn, np.arange(2049))
        table = np.full((2048, int(np.diff(start).max())), -1, dtype=np.int64)
        table[syn, np.arange(len(e)) - start[syn]] = e
        tables.append(table)
    return parity, tables


def anchors_near(word: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, anchor) for every anchor within covering radius + extra of each 23-bit word."""
    parity, tables = golay()
    e = tables[extra][parity[word >> 11] ^ (word & 2047)]
    row, col = np.nonzero(e >= 0)
    return row, (word[row] ^ e[row, col]) >> 11


def block_anchors(fp: np.ndarray, block: tuple, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor of the block that is within covering radius + x and + y of its pieces, x + y <= extra."""
    words = [(fp >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64) for first, bits in block]
    if len(block) == 1:
        return anchors_near(words[0], extra)
    rows, anchors = [], []
    for x in range(extra + 1):
        row, one = anchors_near(words[0], x)
        # anchors of the first piece that are within x and not within x - 1, so that no pair comes twice
        if x:
            parity, tables = golay()
            closer = {0: 3, 1: 4}[x - 1]
            far = np.bitwise_count((one << 11 | parity[one]) ^ words[0][row]) > closer
            row, one = row[far], one[far]
        at, two = anchors_near(words[1], extra - x)
        # every anchor of the first piece with every anchor of the second, by fingerprint
        n, first = np.bincount(at, minlength=len(fp)), np.searchsorted(at, np.arange(len(fp)))
        times = n[row]
        pick = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[row], times)
        rows.append(np.repeat(row, times))
        anchors.append(np.repeat(one, times) << 12 | two[pick])
    return np.concatenate(rows), np.concatenate(anchors)


def replicate(fps: DataFrame, rule: SimHashRule) -> DataFrame:
    """(anchor, fp, wide) for every anchor that a fingerprint has to go to; anchor's bits from the 24th on name the block."""
    wide = rule.wide is not None
    schema = T.StructType([T.StructField("anchor", T.IntegerType()), T.StructField("fp", T.LongType()), *[T.StructField("wide", T.BinaryType())] * wide])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                for k, (block, t) in enumerate(rule.blocks):
                    row, anchor = block_anchors(fp, block, (t + 1) // 2)
                    out = [pa.array((anchor | k << 24).astype(np.int32)), pa.array(fp[row].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(out + ([b.column("wide").take(pa.array(row))] if wide else []), names=schema.names)

    return fps.select(*schema.names[1:]).mapInArrow(run, schema)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the labels (each at most its own place) of a and b the smallest of what is connected by the links."""
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label[:] = up
        if np.array_equal(label[a], label[b]):
            return


def label_links(label: np.ndarray, first: np.ndarray, second: np.ndarray, fp: np.ndarray, wide: np.ndarray | None, rule: SimHashRule) -> None:
    """Labels of the pairs first x second (places) that are linked; looked at in blocks of rows, where both are the same only its upper half."""
    same = first is second
    for at in range(0, len(first), 128):
        rows, others = first[at : at + 128], second[at:] if same else second
        r, c = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, others]) <= rule.threshold)
        if same:
            r, c = r[c > r], c[c > r]
        a, b = rows[r], others[c]
        if wide is not None and len(a):
            near = np.concatenate([np.bitwise_count(wide[a[i : i + 65536]] ^ wide[b[i : i + 65536]]).sum(axis=1) <= rule.wide for i in range(0, len(a), 65536)])
            a, b = a[near], b[near]
        if len(a):
            merge_labels(label, a, b)


def star_runs(cell: np.ndarray, half: np.ndarray, fp: np.ndarray, wide: np.ndarray | None, rule: SimHashRule) -> tuple[np.ndarray, np.ndarray]:
    """(fp, centre) for each fingerprint that is linked with others: the components of every cell, each as a star around its smallest.

    cell: which rows stand together, one cell after the other. half: 0 where all pairs of a cell are meant; in a cell of two slices 1 and 2, whose
    rows are compared with those of the other slice only. Small cells are compared all at once, shifted by one row, by two, and so on."""
    n = len(fp)
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, n])
    label = np.arange(n)
    left = np.repeat(size, size) - (np.arange(n) - np.repeat(start, size)) - 1  # rows of the cell that follow
    small = np.repeat(size <= 64, size)
    a = np.flatnonzero(small & (left > 0))
    found = []
    for shift in range(1, 64):
        a = a[left[a] >= shift]
        if not len(a):
            break
        x = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= rule.threshold]
        x = x[(half[x] == 0) | (half[x] != half[x + shift])]
        if wide is not None:
            x = x[np.bitwise_count(wide[x] ^ wide[x + shift]).sum(axis=1) <= rule.wide]
        found.append((x, x + shift))
    if found:
        merge_labels(label, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    for at, k in zip(start[size > 64], size[size > 64], strict=True):
        rows = np.arange(at, at + k)
        own = half[at : at + k]
        if own.any():
            label_links(label, rows[own == 1], rows[own == 2], fp, wide, rule)
        else:
            label_links(label, rows, rows, fp, wide, rule)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, fp.view(np.int64))
    centre = least[label]
    out = centre != fp.view(np.int64)
    return fp.view(np.int64)[out], centre[out]


def whole_cells(batches, key: list[str], most: int = 1 << 16):
    """Tables of whole cells (rows that agree in the key, sorted by it), of about `most` rows; a cell that is larger alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held)
        at = int(np.argmax(np.logical_and.reduce([(c := table.column(k).to_numpy()) == c[-1] for k in key])))
        if at:  # the last cell may go on in the next batch
            yield table.slice(0, at)
        held = table.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def star_links(fps: DataFrame, rule: SimHashRule, shelf: Shelf) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs that differ in at most the threshold."""
    copies = replicate(fps, rule)
    # anchors with more fingerprints than a cell holds, and how many slices they need
    big = shelf.put(copies.groupBy("anchor").count().where(F.col("count") > rule.cell).select("anchor", F.ceil(F.col("count") / rule.cell).cast("int").alias("k")))
    copies = copies.join(big, "anchor", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    # the cells (i, j), i <= j, in which a fingerprint's slice takes part; one cell for all but large anchors
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    dealt_out = copies.select("*", mine.alias("m")).select("*", other)
    half = F.when(F.col("m") == F.col("o"), 0).when(F.col("m") < F.col("o"), 1).otherwise(2)
    cells = dealt_out.select("anchor", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), half.alias("half"), *[c for c in ("fp", "wide") if c in copies.columns])
    cells = cells.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def run(batches):
        for t in whole_cells(batches, ["anchor", "i", "j"]):
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "i", "j")])
            cell = np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), dtype=np.uint64).reshape(-1, 3) if rule.wide is not None else None
            a, b = star_runs(cell, t.column("half").to_numpy(), t.column("fp").to_numpy().view(np.uint64), wide, rule)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return cells.mapInArrow(run, "a long, b long").distinct()


def fingerprint_roots(slim: DataFrame, rule: SimHashRule, shelf: Shelf) -> DataFrame:
    """(fp, root) for every distinct fingerprint of slim (fp and, if the rule says so, wide); root names its component."""
    # equal fingerprints are one, whatever their second ones, each of which is compared with others
    distinct = shelf.put(slim.select("fp", *["wide"] * (rule.wide is not None)).distinct())
    roots = shelf.put(components(star_links(distinct, rule, shelf), shelf))
    return distinct.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, rule: SimHashRule = SimHashRule(), text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep), fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id that links reach, itself included.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. Rows that repeat stay,
    each with the same component. A row with a null doc_id takes part; a component without any doc_id has component_id null. Columns of docs
    with the names of new ones are replaced. An empty table gives an empty table.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    fp, wide = free_name(docs, "fp", "wide")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("fingerprint", "component_id")]
    wide = wide if rule.wide is not None else None
    made = fingerprints(docs, rule, text, fp, wide, list(dict.fromkeys([doc_id, *kept])))
    slim = shelf.put(made.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{fp}`").alias("fp"), *[F.col(f"`{wide}`").alias("wide")] * bool(wide)))
    roots = shelf.put(fingerprint_roots(slim, rule, shelf))
    least = shelf.put(slim.groupBy("fp").agg(F.min("id").alias("least")))
    lowest = shelf.put(roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    named = shelf.put(roots.join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id"))
    bare = set(kept) <= {doc_id}
    shelf.keep(named, *[slim] * bare)
    base = slim.select(F.col("id").alias(doc_id), F.col("fp").alias(fp)) if bare else made.drop(*[wide] * bool(wide))
    return base.join(named, F.col(f"`{fp}`") == F.col("__fp")).select(*[F.col(f"`{c}`") for c in kept], F.lower(F.lpad(F.hex(F.col(f"`{fp}`")), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class NearRule:
    """shingle: words in a shingle. similarity: the least Jaccard similarity of linked texts' sets of shingles. bands, rows: of the
    signature of bands * rows MinHashes; texts that agree in all rows of a band meet (of pairs at 0.8 all but 3 in 100,000). loose: the
    share of the signature in which texts that meet must agree to be compared (4.2 deviations below 0.8). cell, cell_bytes: signatures
    of a bucket, or texts of a group and their bytes, in a slice; beyond it they are dealt out as cells of two slices."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    loose: float = 0.61
    cell: int = 4096
    cell_bytes: int = 16 << 20


SIMILAR = NearRule()


def signature(h: np.ndarray, places: int) -> np.ndarray:
    """The smallest of the upper 32 bits of each of `places` hashes of the values."""
    at = np.arange(1, places + 1, dtype=np.uint64)[:, None]
    add, times = mix(at), mix(at + np.uint64(places)) | np.uint64(1)
    out = np.full(places, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 4096):
        x = (h[None, k : k + 4096] ^ add) * times
        x ^= x >> np.uint64(32)
        x *= times
        np.minimum(out, x.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(source: DataFrame, rule: NearRule) -> DataFrame:
    """id, ka, kb, node (a hash of the whole set of shingles), fp (its SimHash, each shingle counted once), sketch (a byte for each MinHash)
    and buckets (one a band; none without words)."""

    def make():
        def do(texts):
            node, fp, sketch, buckets = [], [], [], []
            for t in texts:
                h = np.unique(shingle_hashes(t, rule.shingle))
                sig = signature(h, rule.bands * rule.rows)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                fp.append(majority(h))
                sketch.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                bands = sig.reshape(rule.bands, rule.rows)
                buckets.append(np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)] if len(h) else [], dtype=np.uint64).view(np.int64))
            return [*(np.array(x, dtype=np.uint64).view(np.int64) for x in (node, fp)), sketch, buckets]

        return do

    return per_text(source, "text", [("node", T.LongType()), ("fp", T.LongType()), ("sketch", T.BinaryType()), ("buckets", T.ArrayType(T.LongType()))], make, ["id", "ka", "kb"])


def unite(node: np.ndarray, linked, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) for each node that is linked with others: every pair is tested, but for those that are connected before.

    linked(r, js): which of the rows js the row r is linked with. first: the rows from there on are connected from the start, and named only where
    one before them is linked with them."""
    label = np.arange(len(node))
    if first is not None:
        label[first:] = first
    for r in range(min(len(node) - 1, len(node) if first is None else first)):
        js = r + 1 + np.flatnonzero(label[r + 1 :] != label[r])
        if len(js):
            js = js[linked(r, js)]
        if len(js):
            roots = np.unique(label[np.append(js, r)])
            label[np.isin(label, roots)] = roots[0]
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    centre = least[label]
    out = (centre != node) & (np.isin(label, label[:first]) if first is not None else True)
    return node[out], centre[out]


def dealt(members: DataFrame, slices: str = "k") -> DataFrame:
    """members once for each cell (i, j), i <= j, of its key in which its slice takes part; slices: the column with the number of the key's slices."""
    mine = F.pmod(F.xxhash64("node"), F.col(slices)).cast("int")
    cut = members.withColumn("m", mine).select("*", F.explode(F.sequence(F.lit(0), F.col(slices) - 1)).alias("o"))
    return cut.select(*[c for c in members.columns if c != slices], F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"))


def loose_links(nodes: DataFrame, rule: NearRule, shelf: Shelf) -> DataFrame:
    """(a, b): links whose components hold together all nodes that meet in a bucket and agree in enough of the signature."""
    copies = shelf.put(nodes.select(F.explode("buckets").alias("bucket"), "node"))
    size = shelf.put(copies.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / rule.cell).cast("int").alias("k")))
    meet = copies.join(size, "bucket").join(nodes.select("node", "sketch"), "node")
    cells = dealt(meet).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(t: pa.Table) -> pa.RecordBatch:
        """t: whole cells in their order."""
        node = t.column("node").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
        start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        n = np.diff(np.append(start, len(node)))
        two = start[n == 2]
        two = two[(sketch[two] == sketch[two + 1]).mean(axis=1) >= rule.loose]
        a, b = [node[two]], [node[two + 1]]
        for at, k in zip(start[n > 2], n[n > 2], strict=True):
            s = sketch[at : at + k]
            x, y = unite(node[at : at + k], lambda r, js, s=s: (s[js] == s[r]).mean(axis=1) >= rule.loose)
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    def run(batches):
        for t in whole_cells(batches, ["bucket", "i", "j"]):
            yield compare(t)

    return cells.mapInArrow(run, "a long, b long").distinct()


def anchored_links(nodes: DataFrame, rule: NearRule, shelf: Shelf) -> DataFrame:
    """(a, b): links whose components hold together all nodes whose fingerprints differ in at most 3 bits, by the covering."""
    named = shelf.put(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    stars = shelf.put(star_links(named.select("fp"), SimHashRule(rule.shingle), shelf))
    first = lambda c: named.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    far = stars.join(first("a"), "a").join(first("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    same = nodes.select("node", "fp").join(named.where("n > 1"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return far.unionByName(same.where("a != b"))


def shingle_set(text: bytes | None, rule: NearRule) -> np.ndarray:
    return np.unique(shingle_hashes(text, rule.shingle))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def told_first(texts: DataFrame, rule: NearRule) -> DataFrame:
    """(node, first, soft): the first node of a text's group, and whether the text has the similarity with it."""
    first = texts.groupBy("group").agg(F.min("node").alias("first")).select("first")
    chosen = texts.join(first, F.col("node") == F.col("first")).select("group", "first", F.col("text").alias("other"))

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for b in (b for whole in batches for b in steps(whole, "text")):
            soft = []
            for node, at, text, other in zip(b.column("node").to_pylist(), b.column("first").to_pylist(), *(text_bytes(b.column(c)) for c in ("text", "other")), strict=True):
                text, other = text.as_py(), other.as_py() if at not in known else None
                if at not in known:
                    if len(known) > 16:
                        known.clear()
                    known[at] = shingle_set(other, rule)
                soft.append(node == at or jaccard(known[at], shingle_set(text, rule)) >= rule.similarity)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("first"), pa.array(soft, pa.bool_())], names=["node", "first", "soft"])

    return texts.select("group", "node", "text").join(chosen, "group").select("node", "first", "text", "other").mapInArrow(run, "node long, first long, soft boolean")


def similar_links(texts: DataFrame, rule: NearRule, shelf: Shelf) -> DataFrame:
    """(a, b): links whose components are those of all pairs of a group with the similarity. texts: group, node, sketch, bytes, text.

    Every text is compared with its group's first: a group of copies of one text, however many, is done with that. The texts that aren't linked with the
    first (hard) are compared with each other and with those that are (soft), in cells of two slices."""
    flags = shelf.put(told_first(texts, rule))
    rest = texts.join(flags.select("node", "soft"), "node")
    sums = [f(F.when(F.col("soft") == v, x)).alias(n) for v, w in ((False, "hard"), (True, "easy")) for n, f, x in ((w, F.count, F.lit(1)), (f"{w}_bytes", F.sum, F.col("bytes")))]
    slices = lambda n: F.greatest(F.ceil(F.col(n) / rule.cell), F.ceil(F.col(f"{n}_bytes") / rule.cell_bytes)).cast("int")
    size = shelf.put(rest.groupBy("group").agg(*sums).where("hard > 0").select("group", slices("hard").alias("kh"), slices("easy").alias("ke")))
    rest = rest.join(size, "group").select("group", "node", "soft", "sketch", "text", "kh", "ke")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("soft"), F.col("ke")).otherwise(F.col("kh"))).cast("int")
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(upto("kh"), lambda o: cell(0, F.least("m", o), F.greatest("m", o)))
    across = F.transform(upto("ke"), lambda o: cell(1, F.col("m"), o))
    cells = F.when(F.col("soft"), F.transform(upto("kh"), lambda o: cell(1, o, F.col("m")))).otherwise(F.concat(among, across))
    dealt_out = rest.withColumn("m", mine).select("group", "node", "soft", "sketch", "text", F.explode(cells).alias("c")).select("group", "node", "soft", "sketch", "text", "c.*")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("soft")  # the hard ones first
        node, first = table.column("node").to_numpy(), int((~table.column("soft").to_numpy()).sum())
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        sets = [shingle_set(t, rule) for t in table.column("text").cast(pa.binary()).to_pylist()]
        n = np.array([len(s) for s in sets])

        def linked(r: int, js: np.ndarray) -> np.ndarray:
            out = ((sketch[js] == sketch[r]).mean(axis=1) >= rule.loose) & (np.minimum(n[js], n[r]) / np.maximum(n[js], n[r]) >= rule.similarity)
            for x in np.flatnonzero(out):
                out[x] = jaccard(sets[r], sets[js[x]]) >= rule.similarity
            return out

        a, b = unite(node, linked, first)
        return pa.table({"a": a, "b": b})

    found = dealt_out.groupBy("group", "kind", "i", "j").applyInArrow(compare, "a long, b long")
    return flags.where("soft and node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(found.distinct())


def near_dedup(docs: DataFrame, rule: NearRule = SIMILAR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without all but one row of each near-duplicate group: the one with the smallest doc_id (a null counts as the largest) stays.

    Groups are joined by links, and a link is a pair whose sets of shingles have the rule's Jaccard similarity. Pairs are compared if their
    SimHash fingerprints differ in at most 3 bits, all of which meet at anchors, or if their MinHash signatures meet: at a similarity of 0.8
    fingerprints of 64 bits differ in 10 bits, give or take 3, and a covering that reaches so far brings most pairs of a table together.
    Whether a pair is linked depends on the texts alone.
    Texts with equal sets of shingles are one from the start (by 64 bits of hash). Where several rows of a group have the smallest
    doc_id, one of the text with the smallest hash stays, and of equal rows any one. The columns are those of docs. An empty table
    gives an empty table.
    """
    shelf = Shelf(docs.sparkSession, "neardup")
    *keys, ka, kb, whole = free_name(docs, "key_a", "key_b", "ka", "kb", "row")
    i, t = F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")
    keyed = docs.select("*", F.xxhash64(i, t).alias(keys[0]), F.xxhash64(t, F.lit(1), i).alias(keys[1]))
    source = keyed.select(F.col(f"`{doc_id}`").alias("id"), t.cast("string").alias("text"), *[F.col(k).alias(n) for k, n in zip(keys, ("ka", "kb"), strict=True)])
    slim = shelf.put(signatures(source, rule))
    # equal rows are one from here on, with their number
    rows = shelf.put(slim.groupBy("node", "ka", "kb").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    nodes = shelf.put(slim.groupBy("node").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets")))
    near = loose_links(nodes, rule, shelf).unionByName(anchored_links(nodes, rule, shelf))
    groups = shelf.put(components(near, shelf).withColumnRenamed("root", "group"))
    # one row of each node that has company gives the text
    reps = rows.groupBy("node").agg(F.min(F.struct("ka", "kb", "n")).alias("r")).join(groups, "node").join(nodes.select("node", "sketch"), "node")
    reps = shelf.put(reps.select("group", "node", "sketch", "r.*"))
    told = source.select("ka", "kb", "text").join(reps, ["ka", "kb"])
    columns = ["group", "node", "sketch", F.octet_length("text").cast("long").alias("bytes"), "text"]
    texts = told.where("n = 1").select(*columns)
    if reps.where("n > 1").limit(1).count():
        again = told.where("n > 1").groupBy("group", "node", "sketch").agg(F.first("text").alias("text"))
        texts = texts.unionByName(again.select(*columns))
    roots = shelf.put(components(similar_links(shelf.put(texts), rule, shelf), shelf))
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = shelf.put(rooted.select("root", F.struct(F.col("id").isNull().alias("none"), "id", "ka", "kb").alias("row"), "n"))
    first = shelf.put(rooted.groupBy("root").agg(F.min("row").alias("first")))
    judged = shelf.put(rooted.join(first, "root").select("row.ka", "row.kb", (F.col("row") == F.col("first")).alias("stays"), "n"))
    shelf.keep(judged)
    named = [F.col("ka").alias(ka), F.col("kb").alias(kb)]
    on = [F.col(keys[0]) == F.col(ka), F.col(keys[1]) == F.col(kb)]
    out = keyed.join(judged.where("not stays or n > 1").select(*named), on, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = judged.where("stays and n > 1").select(*named)
    any_row = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(whole)
    one = keyed.join(again, on, "left_semi").groupBy(*keys).agg(any_row).select(f"{whole}.*")
    return out.unionByName(one)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_components() of all documents by three-word shingles and 3 bits; edge cases as defined there."""
    return simhash_components(read(spark, sf_dir, "documents"), SimHashRule(), keep=["doc_id"])

"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is built and cut into balanced parts so that few edges are cut. A small neural
network learns, for a vector, in which parts its neighbours lie. Every row goes to its most probable part; a query is routed to its
most probable parts, as many as it takes to reach a share of the probability that is calibrated on rows held out of the fit: few where
the data have clusters, most where they have none. The parts' rows are ranked again by exact distance. Parts are dealt out as chunks
of bounded size; no row is copied, a query goes to the chunks of its parts, and a task holds one chunk while the queries pass by, so that
neither a large part nor a vector that many rows share nor the number of queries bears on a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrel.llm.common import Shelf, read


@dataclass(frozen=True)
class AnnRule:
    """sample: most rows that the partition is learned on (those with the smallest hash of their id and vector); an eighth of them is held
    out for calibration. part_rows: rows of a part, as wanted. parts: fewest and most parts. neighbours: of a sampled vector in the graph.
    recall: share of held-out rows' neighbours that routing has to reach. hidden, epochs: of the classifier. chunk: rows of a part that are
    searched together. seed: of the fit."""

    sample: int = 8192
    part_rows: int = 100_000
    parts: tuple[int, int] = (32, 256)
    neighbours: int = 10
    recall: float = 0.93
    hidden: int = 128
    epochs: int = 12
    chunk: int = 8192
    seed: int = 42


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, in blocks."""
    n, k = len(x), min(k, len(x) - 1)
    sq, out = (x * x).sum(1), np.empty((n, k), dtype=np.int64)
    for at in range(0, n, 512):
        d = sq[None] - 2 * (x[at : at + 512] @ x.T)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each row, none larger than ceil(n / parts): halved again and again. A half starts from the smoothed projection on the
    direction in which the graph's neighbour means spread most (a step of spectral bisection), and rows move to the side where most of
    their neighbours are while both sides keep their size."""
    part = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = first
            continue
        left = n // 2
        cut = len(rows) * left // n
        where = np.full(len(x), -1)
        where[rows] = np.arange(len(rows))
        near = where[graph[rows]]
        inside = near >= 0
        degree = np.maximum(1, inside.sum(1))
        mean = lambda v: (np.where(inside[..., None], v[near], 0).sum(1)) / degree[:, None]  # noqa: B023, E731
        m = mean(x[rows])
        v = rng.standard_normal(x.shape[1])
        c = m - m.mean(0)
        for _ in range(12):
            v = c.T @ (c @ v)
            v /= np.linalg.norm(v) or 1
        value = c @ v
        for _ in range(8):  # the graph pulls neighbours together, the cut keeps the sides' sizes
            value = 0.5 * value + 0.5 * mean(value[:, None])[:, 0]
            value = np.argsort(np.argsort(value, kind="stable"), kind="stable") / len(rows) - 0.5
        order = np.argsort(value, kind="stable")
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, n - left)]
    return part


class Router:
    """A network with one hidden layer that gives the log odds of each part; mass: the share of the probability that a query's parts reach."""

    def __init__(self, w1, b1, w2, b2, mass: float = 1.0):
        self.w1, self.b1, self.w2, self.b2, self.mass = w1, b1, w2, b2, mass

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of each row, the most probable first, and the probability of those before each."""
        z = self(x)
        order = np.argsort(-z, axis=1, kind="stable")
        p = np.exp(np.take_along_axis(z, order, axis=1) - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return order, np.cumsum(p, axis=1) - p


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, rows: int, rule: AnnRule) -> Router:
    """Learned on the rows of x, a sample of a table of so many rows: targets are the shares of the parts among a row and its neighbours."""
    rng = np.random.default_rng(rule.seed)
    parts = max(1, min(max(rule.parts[0], -(-rows // rule.part_rows)), rule.parts[1], len(x) // 16))
    dim = x.shape[1] if x.ndim == 2 else 0
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    every, held = x, x[: len(x) // 8]
    x = x[len(held) :]
    graph = neighbour_graph(x, rule.neighbours)
    part = balanced_parts(x, graph, parts, rng)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x))[:, None], part[np.c_[np.arange(len(x)), graph]]), 1)
    goal /= goal.sum(1, keepdims=True)
    size = [(dim, rule.hidden), (rule.hidden,), (rule.hidden, parts), (parts,)]
    w = [rng.standard_normal(s) * (2 / s[0]) ** 0.5 if len(s) == 2 else np.zeros(s) for s in size]
    scale = np.sqrt(dim)
    w[0] *= scale
    first, second, turn = [np.zeros(s) for s in size], [np.zeros(s) for s in size], 0
    for _ in range(rule.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            a = x[i] @ w[0] + w[1]
            h = np.maximum(a, 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - goal[i]) / len(i)
            dh = (dz @ w[2].T) * (a > 0)
            turn += 1
            for j, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                w[j] -= 0.003 * (first[j] / (1 - 0.9**turn)) / (np.sqrt(second[j] / (1 - 0.999**turn)) + 1e-8)
    router = Router(*w)
    router.mass = calibrate(router, every, held, rule)
    return router


def calibrate(router: Router, x: np.ndarray, held: np.ndarray, rule: AnnRule) -> float:
    """The share of the probability that reaches the parts of so many of the held-out rows' neighbours (held: the first rows of x)."""
    sq = (x * x).sum(1)
    order, before = router.ranked(held)
    place = np.argsort(order, axis=1)
    own = router(x).argmax(1)
    k = min(rule.neighbours, len(x) - 1)
    needed = []
    for at in range(0, len(held), 512):
        d = sq[None] - 2 * (held[at : at + 512] @ x.T)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        rank = np.take_along_axis(place[at : at + 512], own[near], axis=1)
        needed.append(np.take_along_axis(before[at : at + 512], rank, axis=1))
    return float(np.quantile(np.concatenate(needed), rule.recall, method="higher")) + 1e-9


def vectors_of(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): neither null nor zero, no null or non-finite component, of dimension dim, or of the one most
    have (the smaller of two)."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(np.bincount(length[length > 0]).argmax()) if (length > 0).any() else 0
    rows = np.flatnonzero((length == dim) & (length > 0))
    flat = column.take(pa.array(rows)).flatten()
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[ok], x[ok]


def fit_sample(table: DataFrame, vector: str, vec_id: str, rule: AnnRule) -> tuple[Router, int]:
    """The router and the dimension of vectors, from at most rule.sample rows; the dimension most of these have."""
    v = F.col(f"`{vector}`")
    usable = table.where(v.isNotNull() & (F.size(v) > 0)).select(v.cast("array<double>").alias("v"), F.xxhash64(F.col(f"`{vec_id}`"), v).alias("h"))
    rows, got = usable.count(), usable.orderBy("h").limit(rule.sample).toArrow()
    _, x = vectors_of(got.column("v").combine_chunks() if got.num_rows else pa.array([], type=pa.list_(pa.float64())))
    return fit(unit(x), rows, rule), x.shape[1]


def nearest_of(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, qrows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, distance) of the k nearest rows of x to each row of q, ties to the smaller id, a query's own row left out.

    Products of matrices find the candidates, with a margin for their rounding; distances are computed from the differences."""
    sq, own = (x * x).sum(1), (q * q).sum(1)
    d = sq[None] - 2 * (q @ x.T) + own[:, None]
    at = np.searchsorted(rows, qrows)
    there = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == qrows)
    d[np.flatnonzero(there), at[there]] = np.inf
    kth = min(k, len(x)) - 1
    most = np.partition(d, kth, axis=1)[:, kth] + 1e-11 * (own + sq.max())
    one, two = np.nonzero((d <= most[:, None]) & np.isfinite(d))
    exact = np.sqrt(((x[two] - q[one]) ** 2).sum(1))
    order = np.lexsort((ids[two], exact, one))
    one, two, exact = one[order], two[order], exact[order]
    first = np.searchsorted(one, np.arange(len(q)))
    best = np.arange(len(one)) - first[one] < k
    return one[best], two[best], exact[best]


def nearest(table: DataFrame, is_query, k: int = 10, rule: AnnRule = AnnRule(), vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest rows found for each row for which is_query holds.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part, nor do rows with a null
    vec_id. Every other row is indexed; of a query only its own row is left out, so rows that repeat are neighbours at distance 0.
    Ties go to the smaller vec_id. Other columns of the table don't matter. An empty table gives an empty table.
    """
    spark, shelf = table.sparkSession, Shelf(table.sparkSession, "ann")
    router, dim = fit_sample(table, vector, vec_id, rule)
    held = spark.sparkContext.broadcast(router)  # of a fixed size
    # components as they are stored: 4 bytes where the table has floats
    kind = "<f4" if dict(table.dtypes)[vector] == "array<float>" else "<f8"

    def route(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                rows, x = vectors_of(b.column("v"), dim)
                order, before = held.value.ranked(unit(x)) if len(x) else (np.empty((0, 1), dtype=np.int64), np.empty((0, 1)))
                asks = b.column("ask").to_numpy(zero_copy_only=False)[rows].astype(bool)
                probes = (before < held.value.mass).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array(order[:, 0].astype(np.int32)), pa.array([o[:n].tolist() if a else None for o, n, a in zip(order, probes, asks, strict=True)], pa.list_(pa.int32()))], names=["id", "v", "part", "asked"])

    slim = table.where(F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("part", T.IntegerType()), T.StructField("asked", T.ArrayType(T.IntegerType()))])
    rows = shelf.put(slim.mapInArrow(route, schema).withColumn("row", F.monotonically_increasing_id()))
    counts = rows.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row a part
    chunks = F.create_map(*[F.lit(v) for r in counts for v in (r.part, max(1, -(-r.n // rule.chunk)))]) if counts else F.create_map(F.lit(0), F.lit(1))
    items = rows.select("part", F.pmod(F.xxhash64("id", "row"), chunks[F.col("part")]).cast("int").alias("chunk"), F.lit(0).alias("asks"), "id", "row", "v")
    queries = rows.where("asked is not null").select("id", "row", "v", F.explode("asked").alias("part"))
    # a part that no row went to has no chunk
    queries = queries.where(chunks[F.col("part")].isNotNull()).select("*", F.explode(F.sequence(F.lit(0), chunks[F.col("part")] - 1)).alias("chunk"))
    cells = items.unionByName(queries.withColumn("asks", F.lit(1))).repartition("part", "chunk").sortWithinPartitions("part", "chunk", "asks", "row")
    matrix = lambda column: np.frombuffer(b"".join(column.to_pylist()), dtype=kind).astype(np.float64).reshape(len(column), -1)

    def search(batches):
        cell, parts, chunk = None, [], None
        for whole in batches:
            ends = [whole.column(c).to_numpy() for c in ("part", "chunk", "asks")]
            cut = np.flatnonzero(np.logical_or.reduce([e[1:] != e[:-1] for e in ends])) + 1
            for a, b in zip([0, *cut], [*cut, whole.num_rows], strict=True):
                if a == b:
                    continue
                if (here := (ends[0][a], ends[1][a])) != cell:
                    cell, parts, chunk = here, [], None
                run = whole.slice(int(a), int(b - a))
                if not ends[2][a]:
                    parts.append((matrix(run.column("v")), run.column("id").to_numpy(), run.column("row").to_numpy()))
                    continue
                if chunk is None and parts:
                    chunk, parts = [np.concatenate(p) for p in zip(*parts, strict=True)], []
                if chunk is None:
                    continue
                for at in range(0, run.num_rows, 256):
                    some = run.slice(at, 256)
                    ids, own = some.column("id").to_numpy(), some.column("row").to_numpy()
                    q, i, d = nearest_of(*chunk, matrix(some.column("v")), own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[q]), pa.array(chunk[1][i]), pa.array(d)], names=["query_id", "qrow", "vec_id", "score"])

    found = cells.mapInArrow(search, "query_id long, qrow long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest() over all embeddings; queries are the rows whose vec_id is divisible by 100. Edge cases as defined there."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

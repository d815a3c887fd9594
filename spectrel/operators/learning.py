"""Group-safe learning: folds, linear classifiers, out-of-fold and nested scores, permutation.

The models of a cross-validation, of its repetitions and of its permutations are fitted together: a group carries, for each model, the class
that it trains it with (or none), and every Newton step is one pass over the rows that sums the gradients and second derivatives of all
models, in matrix products by batch. How many jobs run depends on the number of steps (some ten), not on that of the models. Rows are stored once, in
blocks of one part, and what a group is used for once a block, so that many models cost a few bytes a block and not a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrel.functions.columns import require_columns
from spectrel.functions.tables import stored, written
from spectrel.operators import decision as de
from spectrel.operators.robust import assert_none, inconsistent

#: Rows of a block of features.
BLOCK_ROWS = 4096
#: Rows whose products are made at once.
CHUNK_ROWS = 1024


@dataclass(frozen=True)
class StageSpec:
    """name, the column that it predicts, and a filter of its rows."""

    name: str
    label: str
    where: str = "true"


#: The stages of the hierarchy.
STAGES = (StageSpec("activity", "activity"), StageSpec("model", "model", "activity = 'target'"), StageSpec("mode_bebop", "mode", "model = 'bebop'"), StageSpec("mode_ar", "mode", "model = 'ar'"))


def filter_stage(rows: DataFrame, spec: StageSpec) -> DataFrame:
    out = rows.where(spec.where)
    if out.select(spec.label).distinct().limit(2).count() < 2:
        raise ValueError(f"stage {spec.name} has fewer than two classes")
    return out


def hash_order(seed, group: str = "group_id"):
    """The MD5 sum of seed (a value or a column) and group."""
    s = seed if not isinstance(seed, int | str) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", s.cast("string"), F.col(group)).cast("binary"))


def hash_rank(rows: DataFrame, order, name: str, keys: Sequence[str] = (), tie: str = "group_id") -> DataFrame:
    """rows with their number from 1 in the order of a column of hexadecimal hashes, by the keys. The hash's first digits cut the rows into 4,096
    buckets of about equal size, numbered on their own; the buckets' sizes give what comes before each. No task sorts all rows."""
    dealt = rows.withColumn("h_", order).withColumn("b_", F.substring("h_", 1, 3))
    size = dealt.groupBy(*keys, "b_").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = size.withColumn("before_", before).drop("count")  # 4,096 rows a key
    within = F.row_number().over(Window.partitionBy(*keys, "b_").orderBy("h_", tie))
    return dealt.withColumn("n_", within).join(offsets, [*keys, "b_"]).withColumn(name, F.col("before_") + F.col("n_")).drop("h_", "b_", "n_", "before_")


def group_table(rows: DataFrame, label: str, group: str = "group_id") -> DataFrame:
    """(group, label) with one label each, else an error."""
    assert_none(inconsistent(rows, group, label), "groups with more than one label")
    return rows.groupBy(group).agg(F.min(label).alias(label))


def group_folds(rows: DataFrame, label: str, splits: int, seed: int = 42, group: str = "group_id", stratify: bool = True) -> DataFrame:
    """(group, label, fold): groups in the order of a hash dealt out in turn, by label if stratified. Reproducible in SQL."""
    ranked = hash_rank(group_table(rows, label, group), hash_order(seed, group), "r_", [label] if stratify else [], group)
    return ranked.select(group, label, F.pmod(F.col("r_") - 1, F.lit(splits)).cast("int").alias("fold"))


def choose_splits(rows: DataFrame, label: str, preferred: int = 5, group: str = "group_id") -> tuple[int, bool]:
    """(splits, stratified): stratified if every class has two groups; the largest of 20, 10, 5 that neither `preferred` nor the smallest class exceeds, else
    the most there can be."""
    sizes = [r["count"] for r in group_table(rows, label, group).groupBy(label).count().collect()]  # a row a class
    stratified = min(sizes) >= 2
    most = min(sizes) if stratified else sum(sizes)
    top = min(preferred, most)
    return next((v for v in (20, 10, 5) if v <= top), top), stratified


def train_test_groups(rows: DataFrame, label: str, test_share: float, seed: int = 42, group: str = "group_id") -> DataFrame:
    """(group, label, test): of every label the first groups in the order of a hash, so that both sides have all classes."""
    groups = group_table(rows, label, group)
    ranked = hash_rank(groups, hash_order(seed, group), "r_", [label], group).join(groups.groupBy(label).agg(F.count("*").alias("n_")), label)
    return ranked.select(group, label, (F.col("r_") <= F.ceil(F.col("n_") * test_share)).alias("test"))


def assert_no_leak(train: DataFrame, test: DataFrame, group: str = "group_id") -> None:
    assert_none(train.select(group).distinct().join(test.select(group), group, "left_semi"), "groups in both sides")


def permuted_labels(groups: DataFrame, label: str, seed: int, group: str = "group_id") -> DataFrame:
    """groups with their labels dealt anew: the i-th group by one hash gets the label of the i-th by another."""
    left = hash_rank(groups.select(group), hash_order(f"{seed}:from", group), "i", tie=group)
    right = hash_rank(groups.select(group, label), hash_order(seed, group), "i", tie=group).select(label, "i")
    return left.join(right, "i").drop("i")


@dataclass
class LinearModel:
    """A classifier fitted by Spark ML: rows with its features in, score columns out."""

    stages: PipelineModel
    classes: list[str]
    centre: dict[str, float]
    scale: dict[str, float]
    columns: list[str]

    def score(self, rows: DataFrame, prefix: str = "score__") -> DataFrame:
        x = self.stages.transform(standardized(rows, self.columns, self.centre, self.scale))
        p = vector_to_array("probability_")
        return x.select(*rows.columns, *[p[i].alias(prefix + c) for i, c in enumerate(self.classes)])


def standardized(rows: DataFrame, columns: Sequence[str], centre: dict, scale: dict) -> DataFrame:
    return rows.select("*", *[((F.col(c) - centre[c]) / scale[c]).alias(f"z_{c}") for c in columns])


def fit_linear(rows: DataFrame, columns: Sequence[str], label: str, max_iter: int = 1000, tol: float = 1e-8) -> LinearModel:
    """Logistic regression on population z-scores, L2 with C = 1, classes weighted to balance, by Spark ML: for a single large fit."""
    stats = rows.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns], F.count("*").alias("n_")).first()
    centre, scale = {c: stats[c]["m"] for c in columns}, {c: stats[c]["s"] if stats[c]["s"] > 1e-12 else 1.0 for c in columns}
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row a class
    names, n = sorted(counts), stats["n_"]
    index, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, c in enumerate(names):
        index = F.when(F.col(label) == c, float(i)).otherwise(index)
        weight = F.when(F.col(label) == c, n / (len(names) * counts[c])).otherwise(weight)
    x = standardized(rows, columns, centre, scale).withColumn("y_", index).withColumn("w_", weight)
    assembler = VectorAssembler(inputCols=[f"z_{c}" for c in columns], outputCol="v_")
    lr = LogisticRegression(featuresCol="v_", labelCol="y_", weightCol="w_", probabilityCol="probability_", rawPredictionCol="raw_", predictionCol="class_", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol, family="binomial" if len(names) == 2 else "multinomial")
    return LinearModel(PipelineModel([assembler, lr.fit(assembler.transform(x))]), names, centre, scale, list(columns))


@dataclass(frozen=True)
class ModelSpec:
    """The classes of a model, and the places of its features among all (None: all)."""

    classes: tuple[str, ...]
    features: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Fits:
    """Models fitted together. coef: by model (1 or classes, features) for features as they are, intercept: (1 or classes); seen: which classes a
    model has trained with. Of two classes, the one row is for the second."""

    columns: list[str]
    specs: list[ModelSpec]
    coef: list[np.ndarray]
    intercept: list[np.ndarray]
    seen: list[np.ndarray]

    def probabilities(self, x: np.ndarray, model: int) -> np.ndarray:
        return _probabilities(x @ self.coef[model].T + self.intercept[model], self.seen[model])

    def as_dict(self, model: int = 0) -> dict:
        """Plain values, for a bundle."""
        use = self.specs[model].features or range(len(self.columns))
        return {"columns": [self.columns[i] for i in use], "classes": list(self.specs[model].classes), "coef": self.coef[model][:, list(use)].tolist(), "intercept": self.intercept[model].tolist()}


def _probabilities(z: np.ndarray, seen: np.ndarray) -> np.ndarray:
    if z.shape[-1] == 1:
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return np.concatenate([1 - p, p], axis=-1)
    z = np.where(seen, z, -np.inf)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _units(batch: pa.RecordBatch, width: int, families: Sequence[Sequence[int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table, x, y) of a batch of blocks, some CHUNK_ROWS rows a unit; y: (models, rows), the rows' class by model. Blocks whose rows are of the same class in every family of models
    (models of the same classes, as those of a cross-validation's folds) are taken together, so that a unit concerns few models or all of its rows."""
    tables, models = batch.column("t_").to_numpy(), sum(map(len, families))
    for t in np.unique(tables):
        own = np.flatnonzero(tables == t)
        b = batch if len(own) == batch.num_rows else batch.take(pa.array(own))
        x, y, n = _matrix(b, "x_", width), _matrix(b, "y_", models), b.column("n_").to_numpy().astype(np.int64)
        first = np.cumsum(n) - n
        _, of = np.unique(np.stack([y[:, list(f)].max(1) for f in families], axis=1), axis=0, return_inverse=True)
        order = np.argsort(of.reshape(-1), kind="stable")
        size = n[order]
        row = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[order], size)
        block = np.repeat(order, size)
        ends = np.r_[0, np.cumsum(np.bincount(of.reshape(-1), weights=n).astype(np.int64))]
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            for i in range(start, end, CHUNK_ROWS):
                some = slice(i, min(i + CHUNK_ROWS, end))
                yield t, x[row[some]], np.ascontiguousarray(y[block[some]].T)


def _summed(dealt: DataFrame, width: int, families: Sequence[Sequence[int]], todo: Sequence[int], lengths: Sequence[int], sums) -> dict[int, np.ndarray]:
    """What sums(table, x, y, out) adds up over all units, by model (table * models + place) of todo, an array of lengths[place] each: by task, then by model. sums adds to
    out[place]."""
    wanted, models = set(todo), len(lengths)

    def run(batches):
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for t, x, y in _units(b, width, families):
                if t not in total:
                    total[t] = [np.zeros(v) for v in lengths]
                sums(t, x, y, total[t])
        for t, out in total.items():
            own = [m for m in range(models) if t * models + m in wanted]
            yield pa.RecordBatch.from_pydict({"m": pa.array([t * models + m for m in own], pa.int32()), "v": pa.array([out[m].tobytes() for m in own], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for m, v in zip(b.column("m").to_pylist(), b.column("v").to_pylist(), strict=True):
                one = np.frombuffer(v)
                total[m] = total[m] + one if m in total else one
        yield pa.RecordBatch.from_pydict({"m": pa.array(list(total), pa.int32()), "v": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    got = dealt.select("t_", "n_", "x_", "y_").mapInArrow(run, "m int, v binary").repartition("m").mapInArrow(add, "m int, v binary").toArrow()
    out = {m: np.zeros(lengths[m % models]) for m in todo}
    for m, v in zip(got.column("m").to_pylist(), got.column("v").to_pylist(), strict=True):
        out[m] = np.frombuffer(v)
    return out


def _products(zt: np.ndarray) -> np.ndarray:
    """The products of any two rows of zt, as np.triu_indices orders them."""
    d, n = zt.shape
    out, at = np.empty((d * (d + 1) // 2, n)), 0
    for i in range(d):
        np.multiply(zt[i:], zt[i], out=out[at : at + d - i])
        at += d - i
    return out


def _curves(zt: np.ndarray, c: np.ndarray, w: np.ndarray, beta: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss by model, gradient, curves) of models with as many classes. zt: (features and 1, rows); c: (models, rows), the rows' class, -1 where a row doesn't
    train the model; w, seen: (models, classes); beta: (models, 1 or classes, features and 1). curves: w * p_u * p_v of a row for all pairs u < v of classes: what the
    second derivatives are sums of."""
    models, rows, d = beta.shape
    score = (beta.reshape(-1, d) @ zt).reshape(models, rows, -1)
    if rows == 1:
        one = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        prob = np.concatenate([1 - one, one], axis=1)
    else:
        if not seen.all():
            score[~seen] = -np.inf
        score -= score.max(axis=1, keepdims=True)
        prob = np.exp(score, out=score)
        prob /= prob.sum(axis=1, keepdims=True)
    hit, i, most = c >= 0, np.arange(models), c.max(axis=1)
    same = bool((hit & (c != most[:, None])).sum() == 0)  # a model's rows are of one class
    if same:
        weight, own = hit * w[i, most][:, None], prob[i, most]
    else:
        some = np.maximum(c, 0)
        weight, own = np.where(hit, np.take_along_axis(w, some, axis=1), 0.0), np.take_along_axis(prob, some[:, None], axis=1)[:, 0]
    loss = -(weight * np.log(np.maximum(own, 1e-300))).sum(axis=1)
    weighted = prob * weight[:, None]
    pairs = list(zip(*np.triu_indices(prob.shape[1], 1), strict=True))
    curves = np.empty((models, len(pairs), zt.shape[1]))
    for a, (u, v) in enumerate(pairs):
        np.multiply(weighted[:, u], prob[:, v], out=curves[:, a])
    if same:
        weighted[i, most] -= weight
    else:
        np.put_along_axis(weighted, some[:, None], (np.take_along_axis(weighted, some[:, None], axis=1)[:, 0] - weight)[:, None], axis=1)
    return loss, weighted[:, -rows:] @ zt.T, curves


def fit_together(dealt: DataFrame, columns: Sequence[str], specs: Sequence[ModelSpec], steps: int = 50, tol: float = 1e-9, tables: int = 1) -> Fits:
    """Logistic regressions (two classes) or softmax regressions on the z-scores of a model's own rows, L2 with C = 1 and no penalty of the intercept,
    classes weighted to balance, by damped Newton steps.

    dealt: blocks of deal(); y_ has by model the number of the class of the block's rows, -1 where they don't train the model. tables: how many tables of features (t_) there are, each with
    models of these specs; model table * models + place. Models with the same features share their z-scores, in the table's scale, and the products of two features: a
    pass multiplies those by the curves of all such models at once. A model's own scale is put in afterwards."""
    p, models = len(columns), len(specs)
    every = range(tables * models)
    kinds = [len(s.classes) for s in specs]
    most = max(kinds)
    use = [np.array(s.features if s.features is not None else range(p), dtype=int) for s in specs]

    families = [[m for m in range(models) if specs[m].classes == c] for c in dict.fromkeys(s.classes for s in specs)]

    def counted(t, x, y, out):
        on = y >= 0
        s1, s2 = on.astype(float) @ x, on.astype(float) @ (x * x)
        for m in np.flatnonzero(on.any(1)):
            out[m][:most] += np.bincount(y[m][on[m]], minlength=most)
            out[m][most : most + p] += s1[m]
            out[m][most + p :] += s2[m]

    got = _summed(dealt, p, families, every, [most + 2 * p] * models, counted)
    first = np.array([got[m] for m in every])
    n = first[:, :most].sum(1)
    if ((first[:, :most] > 0).sum(1) < 2).any():
        raise ValueError("a model has fewer than two classes to train on")
    centre = first[:, most : most + p] / n[:, None]
    # a table's common centre and scale: any will do that keep its numbers in range
    of_table = lambda v: v.reshape(tables, models, -1).sum(1)
    mid = of_table(first[:, most : most + p]) / of_table(n)
    about = of_table(first[:, most + p :]) / of_table(n) - mid * mid
    wide = np.where(about > 1e-9 * mid * mid, np.sqrt(np.maximum(about, 0)), np.where(mid != 0, np.abs(mid), 1.0))
    wide = np.where(wide > 0, wide, 1.0)
    seen = [first[m, : kinds[m % models]] > 0 for m in every]
    weight = [np.where(seen[m], n[m] / (seen[m].sum() * np.maximum(first[m, : kinds[m % models]], 1)), 0.0) for m in every]
    shape = [(1 if k == 2 else k, len(u) + 1) for k, u in zip(kinds, use, strict=True)]
    pairs = [k * (k - 1) // 2 for k in kinds]
    lengths = [1 + r * d + q * (d * (d + 1) // 2) for (r, d), q in zip(shape, pairs, strict=True)]
    # parameters of classes that a model has seen
    free = [np.repeat(np.ones(1, dtype=bool) if shape[m % models][0] == 1 else seen[m], shape[m % models][1]) for m in every]
    penalty = [np.tile(np.r_[np.ones(d - 1), 1e-9], r) for r, d in shape]
    # a softmax doesn't change if all its intercepts do alike, and at the optimum their sum is 0: a step in that direction would be rounding errors over 1e-9, which never end
    alike = [np.tile(np.r_[np.zeros(shape[m % models][1] - 1), float(shape[m % models][0] > 1)], shape[m % models][0])[free[m]] for m in every]
    alike = [v / max(1.0, np.linalg.norm(v)) for v in alike]

    def sums(beta: dict[int, np.ndarray], spread: bool):
        """Sums of a Newton step; with spread those of the squared distances from a model's own centre, after the others."""
        plan: dict[int, dict] = {}
        for g in beta:
            t, m = divmod(g, models)
            plan.setdefault(t, {}).setdefault(tuple(use[m]), {}).setdefault(kinds[m], []).append(m)

        def off(t, x, y, out):
            alike: dict[bytes, list[int]] = {}
            for m in np.flatnonzero((y >= 0).any(1)):
                alike.setdefault((y[m] >= 0).tobytes(), []).append(m)
            for ms in alike.values():
                own = x[y[ms[0]] >= 0]
                mean = own.mean(0)
                around = ((own - mean) ** 2).sum(0)
                for m in ms:
                    out[m][lengths[m] :] += around + len(own) * (mean - centre[t * models + m]) ** 2

        def of(t, x, y, out):
            if spread:
                off(t, x, y, out)
            on = (y >= 0).any(1)
            z = np.ones((p + 1, len(x)))
            z[:-1] = ((x - mid[t]) / wide[t]).T
            for features, by_kind in plan.get(t, {}).items():
                found, curves = [], []
                zt = z[[*features, p]]
                for ms in by_kind.values():
                    ms = [m for m in ms if on[m]]
                    if ms:
                        g = [t * models + m for m in ms]
                        loss, grad, curve = _curves(zt, y[ms], np.array([weight[m] for m in g]), np.array([beta[m] for m in g]), np.array([seen[m] for m in g]))
                        found.append((ms, loss, grad.reshape(len(ms), -1), curve.shape[1]))
                        curves.append(curve.reshape(-1, curve.shape[-1]))
                if not found:
                    continue
                h, at = np.concatenate(curves) @ _products(zt).T, 0
                for ms, loss, grad, q in found:
                    for i, m in enumerate(ms):
                        d = grad.shape[1]
                        out[m][0] += loss[i]
                        out[m][1 : 1 + d] += grad[i]
                        out[m][1 + d : lengths[m]] += h[at : at + q].reshape(-1)
                        at += q

        return of

    def curvature(m: int, v: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The second derivatives of a model, in its own scale, from the sums by pairs of classes."""
        (r, d), k = shape[m], kinds[m]
        i, j = np.triu_indices(d)
        one = np.empty((pairs[m], d, d))
        one[:, i, j] = one[:, j, i] = v.reshape(pairs[m], -1)
        one = to @ one @ to.T
        if r == 1:
            return one[0]
        h = np.zeros((r, d, r, d))
        for a, (u, w) in enumerate(zip(*np.triu_indices(k, 1), strict=True)):
            h[u, :, u, :] += one[a]
            h[w, :, w, :] += one[a]
            h[u, :, w, :] -= one[a]
            h[w, :, u, :] -= one[a]
        return h.reshape(r * d, r * d)

    best = [np.zeros(shape[m % models][0] * shape[m % models][1]) for m in every]
    step, loss, todo = [np.zeros_like(b) for b in best], np.full(len(best), np.inf), list(every)
    scale, to = np.ones((len(best), p)), [np.eye(shape[m % models][1]) for m in every]
    for turn in range(steps):
        if not todo:
            break
        tried = {m: best[m] + step[m] for m in todo}
        # scores of z-scores as scores of the table's numbers
        beta = {m: tried[m].reshape(shape[m % models]) @ to[m] for m in todo}
        got, going = _summed(dealt, p, families, todo, [v + p * (turn == 0) for v in lengths], sums(beta, turn == 0)), []
        if turn == 0:
            scale = np.sqrt(np.array([got[m][lengths[m % models] :] for m in every]) / n[:, None])
            scale[scale <= 1e-12] = 1.0
            for m in every:
                t, u = m // models, use[m % models]
                to[m][range(len(u)), range(len(u))] = wide[t, u] / scale[m, u]
                to[m][:-1, -1] = (mid[t, u] - centre[m, u]) / scale[m, u]
        for m in todo:
            (r, c), pull = shape[m % models], penalty[m % models]
            d = r * c
            now = got[m][0] + 0.5 * (pull * tried[m] * tried[m]).sum()
            if now > loss[m] + 1e-9 * abs(loss[m]):
                step[m] = step[m] / 2
            else:
                best[m], loss[m] = tried[m], now
                g = ((got[m][1 : 1 + d].reshape(r, c) @ to[m].T).reshape(-1) + pull * best[m])[free[m]]
                h = (curvature(m % models, got[m][1 + d : lengths[m % models]], to[m]) + np.diag(pull))[np.ix_(free[m], free[m])]
                v = alike[m]
                step[m] = np.zeros(d)
                step[m][free[m]] = -np.linalg.solve(h + np.outer(v, v) * np.abs(h).max(), g - v * (v @ g))
            if np.abs(step[m]).max() >= tol * (1 + np.abs(best[m]).max()):
                going.append(m)
        todo = going
    coef, intercept = [], []
    for m in every:
        b, u = best[m].reshape(shape[m % models]), use[m % models]
        own = b[:, :-1] / scale[m][u]
        whole = np.zeros((len(b), p))
        whole[:, u] = own
        coef.append(whole)
        intercept.append(b[:, -1] - own @ centre[m][u])
    return Fits(list(columns), list(specs) * tables, coef, intercept, seen)


def class_names(rows: DataFrame, label: str) -> list[str]:
    return sorted(r[0] for r in rows.select(label).distinct().collect())  # a row a class


def pack(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows' features in blocks of some thousand rows of one part: t_ (the table, 0), group_id, part, blocks_ (of the part), n_ (rows), x_ (n_ * columns numbers).
    A group's rows are dealt to as many blocks as they fill, so that a group of very many rows is nobody's alone."""
    require_columns(rows, ["group_id", "part", *columns])
    size = rows.groupBy("group_id", "part").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks_"))
    x = F.array(*[F.col(c).cast("double") for c in columns])
    every = F.xxhash64(*[F.col(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()])
    slim = rows.select("group_id", "part", x.alias("x_"), every.alias("h_")).join(size, ["group_id", "part"])
    packed = slim.groupBy("group_id", "part", "blocks_", F.pmod(F.col("h_"), F.col("blocks_")).alias("b_")).agg(F.count("*").cast("int").alias("n_"), F.flatten(F.collect_list("x_")).alias("x_"))
    return packed.drop("b_").withColumn("t_", F.lit(0))


def deal(rows: DataFrame, columns: Sequence[str], groups: DataFrame) -> DataFrame:
    """The rows' features in blocks (pack), with what their group is used for (groups: group_id, y_, tests_), stored.

    What a group is used for is held once a block, not once a row."""
    return deal_blocks(pack(rows, columns), groups)


def deal_blocks(packed: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks of pack() with y_ and tests_ of their group, stored, those that are used alike side by side."""
    uses = groups.select("group_id", F.col("y_").cast("array<tinyint>").alias("y_"), "tests_")
    return written(packed.join(uses.hint("shuffle_hash"), "group_id").sortWithinPartitions("t_", "y_"), "blocks")


def scored_groups(dealt: DataFrame, fits: Fits, tables: int = 1, runs: int = 1) -> DataFrame:
    """(run, group_id, label, fold, scores, parts_used): the group scores (mean of its parts' medians; an array of class, score) of every run that tests the group. tests_
    names runs, models and folds, and the label of the run; of several tables those of table t are the runs from t * runs on.

    A part in one block has its medians there. Only for parts of more blocks the rows' scores are shuffled. Blocks of as many rows are scored by a model together."""
    p, models = len(fits.columns), len(fits.specs) // tables
    names = ["t_", "group_id", "part", "tests_", "s_"]
    kinds = np.array([len(s.classes) for s in fits.specs])

    def nested(values: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> pa.ListArray:
        ends = lambda v: pa.array(v, pa.int32())
        return pa.ListArray.from_arrays(ends(outer), pa.ListArray.from_arrays(ends(np.r_[0, np.cumsum(inner)]), pa.array(values)))

    def medians(batches):
        for b in batches:
            x, n = _matrix(b, "x_", p), b.column("n_").to_numpy().astype(np.int64)
            first, tests = np.cumsum(n) - n, b.column("tests_")
            at = tests.offsets.to_numpy().astype(np.int64)
            block = np.repeat(np.arange(b.num_rows), np.diff(at))
            model = b.column("t_").to_numpy()[block] * models + tests.values.field("model").to_numpy()[at[0] : at[-1]]
            many = kinds[model]
            place, values = np.cumsum(many) - many, np.empty(many.sum())
            order = np.lexsort((n[block], model))
            new = np.flatnonzero((np.diff(model[order]) != 0) | (np.diff(n[block[order]]) != 0)) + 1
            for alike in np.split(order, new):  # tests of one model, of blocks of one length
                g, size = model[alike[0]], n[block[alike[0]]]
                for k in range(0, len(alike), max(1, BLOCK_ROWS // size)):
                    some = alike[k : k + max(1, BLOCK_ROWS // size)]
                    prob = fits.probabilities(x[(first[block[some]][:, None] + np.arange(size)).reshape(-1)], g)
                    values[place[some][:, None] + np.arange(kinds[g])] = np.median(prob.reshape(len(some), size, -1), axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-1]], nested(values, many, at - at[0])], names=names)

    def every(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                x, own = _matrix(b, "x_", p), [b.column("t_")[0].as_py() * models + t["model"] for t in b.column("tests_")[0].as_py()]
                values = np.concatenate([fits.probabilities(x, g) for g in own], axis=1)
                row = pa.array(np.zeros(len(x), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(row) for c in names[:-1]], nested(values.reshape(-1), np.tile(kinds[own], len(x)), np.arange(len(x) + 1) * len(own))], names=names)

    one = "struct<run:int,model:int,fold:int,label:string>"
    schema = f"t_ int, group_id string, part string, tests_ array<{one}>, s_ array<array<double>>"
    tested = dealt.where(F.size("tests_") > 0).select("t_", "group_id", "part", "blocks_", "n_", "x_", F.col("tests_").cast(f"array<{one}>").alias("tests_"))
    parts = tested.where("blocks_ = 1").mapInArrow(medians, schema)
    rows = tested.where("blocks_ > 1").mapInArrow(every, schema)
    long = rows.select("t_", "group_id", "part", "tests_", F.posexplode("s_").alias("i_", "v_")).select("t_", "group_id", "part", "tests_", "i_", F.posexplode("v_").alias("j_", "v_"))
    long = long.groupBy("t_", "group_id", "part", "i_", "j_").agg(F.first("tests_").alias("tests_"), F.median("v_").alias("v_"))
    long = long.groupBy("t_", "group_id", "part", "i_").agg(F.first("tests_").alias("tests_"), F.sort_array(F.collect_list(F.struct("j_", "v_")))["v_"].alias("v_"))
    long = long.groupBy("t_", "group_id", "part").agg(F.first("tests_").alias("tests_"), F.sort_array(F.collect_list(F.struct("i_", "v_")))["v_"].alias("s_"))
    by = parts.unionByName(long).groupBy("t_", "group_id").agg(F.first("tests_").alias("tests_"), F.collect_list("s_").alias("l_"))
    classes = F.array(*[F.array(*[F.lit(c) for c in s.classes]) for s in fits.specs[:models]])
    mean = lambda i, j: F.aggregate("l_", F.lit(0.0), lambda a, s: a + s[i][j]) / F.size("l_")
    scores = lambda t, i: F.transform(F.get(classes, t["model"]), lambda c, j: F.struct(c.alias("class"), mean(i, j).alias("score")))
    each = F.transform("tests_", lambda t, i: F.struct((F.col("t_") * runs + t["run"]).alias("run"), t["fold"].alias("fold"), t["label"].alias("label"), scores(t, i).alias("scores")))
    out = by.select("group_id", F.size("l_").cast("long").alias("parts_used"), F.explode(each).alias("e_"))
    return out.select("e_.run", "group_id", "e_.label", "e_.fold", "e_.scores", "parts_used")


def scored_runs(dealt: DataFrame, fits: Fits) -> DataFrame:
    """(run, group_id, label, fold, class, score, parts_used): scored_groups() with a row a class."""
    rows = scored_groups(dealt, fits).select("run", "group_id", "fold", "label", "parts_used", F.explode("scores").alias("s_"))
    return rows.select("run", "group_id", "fold", "label", "s_.class", "parts_used", "s_.score")


def wide_scores(long: DataFrame, classes: Sequence[str], label: str, prefix: str = "score__") -> DataFrame:
    """(run, group_id, label, fold, parts_used, score__...) of runs with the same classes."""
    one = lambda c: F.coalesce(F.min(F.when(F.col("class") == c, F.col("score"))), F.lit(0.0)).alias(prefix + c)
    return long.groupBy("run", "group_id", "fold", F.col("label").alias(label)).agg(F.min("parts_used").alias("parts_used"), *[one(c) for c in classes])


def run_table(groups: DataFrame, label: str, seeds: Sequence[tuple[int, int]], splits: int, permute: bool = False) -> DataFrame:
    """(run, group_id, label, fold): the groups' folds for several runs (run, seed), with labels dealt anew for each if permute."""
    spark = groups.sparkSession
    runs = spark.createDataFrame(list(seeds), "run int, seed long")
    each = groups.select("group_id", label).crossJoin(F.broadcast(runs))
    seed = F.col("seed")
    if permute:
        left = hash_rank(each.select("run", "seed", "group_id"), hash_order(F.concat(seed.cast("string"), F.lit(":from"))), "i", ["run"])
        right = hash_rank(each, hash_order(seed), "i", ["run"]).select("run", label, "i")
        each = left.join(right, ["run", "i"]).drop("i")
    ranked = hash_rank(each, hash_order(seed), "r_", ["run", label])
    return ranked.select("run", "group_id", label, F.pmod(F.col("r_") - 1, F.lit(splits)).cast("int").alias("fold"))


def _class_number(label, classes: Sequence[str]):
    return F.array_position(F.array(*[F.lit(c) for c in classes]), label) - 1


def oof_scores(packed: DataFrame, columns: Sequence[str], runs: DataFrame, specs: Sequence[ModelSpec], splits: int, tables: int = 1) -> DataFrame:
    """(run, group_id, label, fold, scores, parts_used): out-of-fold group scores of several runs (scored_groups) from blocks of features (pack), all models fitted together. Of
    several tables every one has these runs and models; those of table t are the runs from t * len(specs) on.

    runs: run (numbers specs), group_id, label, fold. A group without a row in a run takes no part in it; no group is on both sides of a fold. A fold that
    holds no group trains nothing."""
    number = F.lit(None).cast("int")
    for r, spec in enumerate(specs):
        number = F.when(F.col("run") == r, _class_number(F.col("label"), spec.classes)).otherwise(number)
    runs = stored(runs.select("run", "group_id", "label", "fold", number.cast("int").alias("c_")))
    filled = {(r.run, r.fold) for r in runs.select("run", "fold").distinct().collect()}  # a row a run and fold
    models = [(r, f) for r in range(len(specs)) for f in range(splits) if (r, f) in filled]
    place = F.create_map(*[F.lit(v) for i, (r, f) in enumerate(models) for v in (r * splits + f, i)])
    by_group = runs.groupBy("group_id").agg(F.collect_list(F.struct("run", "label", "c_", "fold")).alias("r_"))
    by_group = by_group.withColumn("m_", F.map_from_entries(F.transform("r_", lambda r: F.struct(r["run"], r))))
    own = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(f).alias("f")) for r, f in models])
    y = F.transform(own, lambda m: F.coalesce(F.when(F.try_element_at("m_", m["r"])["fold"] != m["f"], F.try_element_at("m_", m["r"])["c_"]), F.lit(-1)))
    tests = F.transform(F.array_sort("r_"), lambda r: F.struct(r["run"].alias("run"), place[r["run"] * splits + r["fold"]].alias("model"), r["fold"].alias("fold"), r["label"].alias("label")))
    dealt = deal_blocks(packed, by_group.select("group_id", y.alias("y_"), tests.alias("tests_")))
    return scored_groups(dealt, fit_together(dealt, columns, [specs[r] for r, _ in models], tables=tables), tables, len(specs))


def oof_long(rows: DataFrame, columns: Sequence[str], runs: DataFrame, specs: Sequence[ModelSpec], splits: int) -> DataFrame:
    """(run, group_id, label, fold, class, score, parts_used): oof_scores() of rows, with a row a class."""
    out = oof_scores(pack(rows, columns), columns, runs, specs, splits)
    return out.select("run", "group_id", "fold", "label", "parts_used", F.explode("scores").alias("s_")).select("run", "group_id", "fold", "label", "s_.class", "parts_used", "s_.score")


def oof_runs(rows: DataFrame, columns: Sequence[str], label: str, seeds: Sequence[tuple[int, int]], splits: int, permute: bool = False) -> DataFrame:
    """(run, group_id, label, fold, parts_used, score__...): out-of-fold group scores for several runs (run from 0, seed) of one model. A class that a
    fold lacks scores 0."""
    groups = stored(group_table(rows, label))
    classes = class_names(groups, label)
    runs = run_table(groups, label, seeds, splits, permute).withColumnRenamed(label, "label")
    return wide_scores(oof_long(rows, columns, runs, [ModelSpec(tuple(classes))] * len(seeds), splits), classes, label)


def out_of_fold(rows: DataFrame, columns: Sequence[str], label: str, splits: int, seed: int = 42) -> DataFrame:
    """(group_id, label, fold, parts_used, score__...) of every group by the model of the other folds."""
    return oof_runs(rows, columns, label, [(0, seed)], splits).drop("run")


def nested_binary(rows: DataFrame, columns: Sequence[str], label: str, outer: int = 5, inner: int = 4, seed: int = 42, repeats: int = 1) -> tuple[DataFrame, DataFrame]:
    """((repeat, group_id, label, fold, score, threshold, prediction), the trace): the threshold of an outer fold comes from inner out-of-fold scores
    of its training groups only. Trace: (repeat, fold, group_id, role), where role says what the group was used for: test, train, threshold.

    repeats * outer * (inner + 1) models, fitted together."""
    groups = stored(group_table(rows, label))
    classes = class_names(groups, label)
    first = repeats * outer  # models of the outer folds come first
    outside = stored(run_table(groups, label, [(r, seed + r) for r in range(repeats)], outer))
    folds = F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("g")
    within = outside.select("run", "group_id", label, "fold", folds).where("fold <> g").withColumn("seed", F.lit(seed + 1000) + F.col("run") * 100 + F.col("g"))
    within = hash_rank(within, hash_order(F.col("seed")), "r_", ["run", "g", label]).select("run", "group_id", label, "g", F.pmod(F.col("r_") - 1, F.lit(inner)).cast("int").alias("fold"))
    number = _class_number(F.col(label), classes).cast("int")
    # what a group does: train (model, class) and be tested (run, model)
    model = F.col("run") * outer + F.col("g")
    uses = outside.select("group_id", folds, "run", "fold", label).select("group_id", F.when(F.col("fold") != F.col("g"), model).alias("train"), F.when(F.col("fold") == F.col("g"), F.struct(F.col("run").alias("run"), model.cast("int").alias("model"), F.col("fold").alias("fold"), F.col(label).alias("label"))).alias("test"), number.alias("c_"))
    inner_model = first + (F.col("run") * outer + F.col("g")) * inner + F.col("h")
    inner_run = (repeats + F.col("run") * outer + F.col("g")).cast("int")
    more = within.select("*", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))).alias("h"))
    uses = uses.unionByName(more.select("group_id", F.when(F.col("fold") != F.col("h"), inner_model).alias("train"), F.when(F.col("fold") == F.col("h"), F.struct(inner_run.alias("run"), inner_model.cast("int").alias("model"), F.col("g").alias("fold"), F.col(label).alias("label"))).alias("test"), number.alias("c_")))
    models = first + repeats * outer * inner
    by_group = uses.groupBy("group_id").agg(F.collect_set("train").alias("t_"), F.min("c_").alias("c_"), F.collect_list("test").alias("tests_"))
    y = F.transform(F.sequence(F.lit(0), F.lit(models - 1)), lambda m: F.when(F.array_contains("t_", m), F.col("c_")).otherwise(-1).cast("int"))
    dealt = deal(rows, columns, by_group.select("group_id", y.alias("y_"), "tests_"))
    long = scored_runs(dealt, fit_together(dealt, columns, [ModelSpec(tuple(classes))] * models)).where(F.col("class") == de.TARGET)
    scores = stored(long.select("run", "group_id", "fold", F.col("label").alias(label), F.round("score", 9).alias("score")))
    inside = scores.where(F.col("run") >= repeats).withColumn("key", F.col("run") - repeats)
    limits = de.choose_thresholds(inside, ["key"], "score", label).select((F.floor(F.col("key") / outer)).cast("int").alias("run"), F.pmod("key", F.lit(outer)).cast("int").alias("fold"), "threshold")
    tested = scores.where(F.col("run") < repeats).join(limits, ["run", "fold"])
    decided = de.decide_binary(tested, F.col("threshold"), 0.0).select(F.col("run").alias("repeat"), "group_id", label, "fold", "score", "threshold", "prediction")
    roles = outside.select(F.col("run").alias("repeat"), folds, "group_id", "fold").select("repeat", F.col("g").alias("fold"), "group_id", F.when(F.col("fold") == F.col("g"), "test").otherwise("train").alias("role"))
    used = inside.select(F.floor(F.col("key") / outer).cast("int").alias("repeat"), F.pmod("key", F.lit(outer)).cast("int").alias("fold"), "group_id", F.lit("threshold").alias("role"))
    return decided, roles.unionByName(used)


def permutation_scores(rows: DataFrame, columns: Sequence[str], label: str, seeds: Sequence[int], splits: int = 5) -> DataFrame:
    """(seed, threshold, and the report) of out-of-fold decisions at each run's own best threshold, with labels dealt anew."""
    scores = oof_runs(rows, columns, label, list(enumerate(seeds)), splits, permute=True).withColumn("score", F.round(f"score__{de.TARGET}", 9))
    scores = stored(scores)
    decided = de.decide_binary(scores.join(de.choose_thresholds(scores, ["run"], "score", label).select("run", "threshold"), "run"), F.col("threshold"), 0.0)
    report = de.report(decided, label, "prediction", ["run"]).join(decided.groupBy("run").agg(F.min("threshold").alias("threshold")), "run")
    return report.withColumn("seed", F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("run") + 1)).drop("run")


def evaluate(rows: DataFrame, columns: Sequence[str], label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """The report (by group) of a model trained on all groups but the test share, with the number of rows and groups on both sides."""
    sides = train_test_groups(rows, label, test_share, seed)
    classes = class_names(sides, label)
    c = _class_number(F.col(label), classes).cast("int")
    test = F.struct(F.lit(0).alias("run"), F.lit(0).alias("model"), F.lit(0).alias("fold"), F.col(label).alias("label"))
    used = sides.select("group_id", F.array(F.when(F.col("test"), -1).otherwise(c)).alias("y_"), F.when(F.col("test"), F.array(test)).otherwise(F.array().cast("array<struct<run:int,model:int,fold:int,label:string>>")).alias("tests_"))
    dealt = deal(rows, columns, used)
    scores = wide_scores(scored_runs(dealt, fit_together(dealt, columns, [ModelSpec(tuple(classes))])), classes, label)
    cols = [f"score__{c}" for c in classes]
    on = F.size("tests_") == 0
    rows_of = lambda on: F.sum(F.when(on, F.col("n_")).otherwise(0))
    sizes = dealt.agg(rows_of(on).alias("n_train"), rows_of(~on).alias("n_test"), F.count_distinct(F.when(on, F.col("group_id"))).alias("train_groups"), F.count_distinct(F.when(~on, F.col("group_id"))).alias("test_groups"))
    return de.report(de.top_predictions(scores, cols), label, "prediction").crossJoin(F.broadcast(sizes))


def cross_validation(rows: DataFrame, columns: Sequence[str], label: str, preferred: int = 20, seed: int = 42) -> DataFrame:
    """(fold, splitter, n_splits, n_test, accuracy, balanced_accuracy, f1_macro ...): the report of every fold, and of all as fold -1."""
    splits, stratified = choose_splits(rows, label, preferred)
    scores = out_of_fold(rows, columns, label, splits, seed)
    top = stored(de.top_predictions(scores, [c for c in scores.columns if c.startswith("score__")]))
    whole = de.report(top, label, "prediction").withColumn("fold", F.lit(-1))
    by = de.report(top, label, "prediction", ["fold"]).unionByName(whole)
    return by.withColumns({"splitter": F.lit("stratified groups" if stratified else "groups"), "n_splits": F.lit(splits), "n_test": F.col("n_groups")})


def fit_final(rows: DataFrame, columns: Sequence[str], label: str) -> Fits:
    """One model of all rows."""
    return fit_finals(rows, columns, [StageSpec("", label)])


def fit_finals(rows: DataFrame, columns: Sequence[str], stages: Sequence[StageSpec]) -> Fits:
    """A model of each stage, of all the rows that it is for, fitted together."""
    specs, numbers = [], []
    for stage in stages:
        groups = group_table(filter_stage(rows, stage), stage.label)
        classes = class_names(groups, stage.label)
        specs.append(ModelSpec(tuple(classes)))
        numbers.append(F.when(F.expr(stage.where), _class_number(F.col(stage.label), classes)).otherwise(-1).cast("int"))
    used = rows.groupBy("group_id").agg(*[F.min(c).alias(c) for c in dict.fromkeys([*[s.label for s in stages], *[c for c in ("activity", "model") if c in rows.columns]])])
    none = F.array().cast("array<struct<run:int,model:int,fold:int,label:string>>")
    return fit_together(deal(rows, columns, used.select("group_id", F.array(*numbers).alias("y_"), none.alias("tests_"))), columns, specs)


def model_scores(rows: DataFrame, model: dict, prefix: str = "score__") -> DataFrame:
    """rows with the scores of a model given by plain values (Fits.as_dict), as column expressions."""
    z = []
    for coef, intercept in zip(model["coef"], model["intercept"], strict=True):
        total = F.lit(float(intercept))
        for c, v in zip(model["columns"], coef, strict=True):
            total = total + float(v) * F.col(c)
        z.append(total)
    if len(z) == 1:
        p = 1 / (1 + F.exp(-z[0]))
        return rows.withColumns({prefix + model["classes"][0]: 1 - p, prefix + model["classes"][1]: p})
    most = F.greatest(*z)
    e = [F.exp(v - most) for v in z]
    return rows.withColumns({prefix + c: v / sum(e[1:], e[0]) for c, v in zip(model["classes"], e, strict=True)})

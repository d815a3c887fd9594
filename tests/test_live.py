"""Streams with state: framing, decisions, late samples and parts that stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.operators import framing as fr
from spectrel.streaming import live, replay

START = 1_700_000_000


def test_ring():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(100)
    for size, hop in ((16, 8), (8, 8), (5, 9), (7, 1)):
        want = [(i, x[i * hop : i * hop + size].tolist()) for i in range((100 - size) // hop + 1)]
        ring, got = live.Ring(size, hop), []
        for part in np.array_split(rng.permutation(100), 7):  # out of order, and some twice
            n = np.r_[part, part[:3]]
            got += [(i, w.tolist()) for i, w in ring.push(n, np.r_[x[part], np.full(3, 99.0)[: len(n) - len(part)]], n, 0)]
        assert got == want
        assert len(ring.n) < size + hop
    # a sample that never comes: frames with it are passed over once later ones are settled
    ring = live.Ring(4, 2)
    n = np.array([0, 1, 2, 3, 4, 6, 7, 8, 9, 10])
    assert [i for i, _ in ring.push(n, n * 1.0, n, 0)] == [0] and ring.idx == 1
    assert [i for i, _ in ring.push(n[:0], n[:0] * 1.0, n[:0], 20)] == [3] and ring.idx == 4
    ring = live.Ring(4, 2)
    assert [i for i, _ in ring.push(n[n < 5], n[n < 5] * 1.0, n[n < 5], 20)] == [0]  # nothing later: it may still come
    assert [i for i, _ in ring.push(n[5:], n[5:] * 1.0, n[5:], 5)] == []
    assert [i for i, _ in ring.push(np.array([5]), np.array([5.0]), np.array([5]), 6)] == [1, 2, 3]


def written(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


rms = live.frame_rms
SCHEMA = "group_id string, part string, n long, x double, at long"


def stream(spark, folder, batches, delay, idle=3_600_000, size=8, hop=4, step=2):
    files = written(spark, folder, batches, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("at"))).drop("at")
    out = live.live_decisions(live.live_scores(files, size, hop, rms, step, 10, delay, idle), 1.0, 0.01)
    return live.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint")


def test_evolution_equals_the_batch_form(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"g{g}", p, i, float(v), START + i) for g in range(3) for p, n in (("L", 60), ("H", 45 + g)) for i, v in enumerate(rng.standard_normal(n))]
    order = rng.permutation(len(rows))
    batches = [[rows[i] for i in part] + [rows[order[0]]] for part in np.array_split(order, 3)]  # out of order; one sample comes again and again
    got = live.last_rows(stream(spark, tmp_path, batches, "1 day")).toPandas().sort_values(["group_id", "stop"]).reset_index(drop=True)
    samples = spark.createDataFrame(rows, SCHEMA)
    scored = fr.framed(samples, 8, 4).groupBy("group_id", "part", "idx").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("score"))
    want = replay.evolution(scored, 1.0, 0.01, step=2, most=10).toPandas().sort_values(["group_id", "stop"]).reset_index(drop=True)
    assert len(got) == len(want) > 10
    for c in want.columns:
        assert np.allclose(got[c], want[c]) if c == "score" else (got[c] == want[c]).all(), c


def test_late_samples_and_parts_that_stop(spark, tmp_path):
    one = lambda g, part, ns, at=0: [(g, part, n, 1.0 + n, START + n + at) for n in ns]
    batches = [
        one("a", "L", [n for n in range(20) if n != 9]) + one("b", "L", range(12)),
        one("a", "L", range(20, 200)),
        one("a", "L", [9]) + one("a", "L", range(200, 220)),  # sample 9 is far too late
        one("a", "L", range(220, 400)),
    ]
    rows = stream(spark, tmp_path, batches, "10 seconds", idle=30_000)
    a = {r.stop: r for r in live.last_rows(rows).where("group_id = 'a'").collect()}
    # frames 1 and 2 hold sample 9: frames 0, 3, 4, ... are scored
    frames = [[1.0 + n for n in range(4 * i, 4 * i + 8)] for i in (0, 3, 4, 5)]
    scores = rms(np.array(frames))
    assert a[2].score == pytest.approx(np.median(scores[:2])) and a[4].score == pytest.approx(np.median(scores))
    assert max(a) == 10 and all(r.parts_used == 1 for r in a.values())
    stopped = rows.where("stopped and group_id = 'b'").collect()
    assert [(r.stop, r.parts_used) for r in stopped] == [(2, 1)] and stopped[0].score == pytest.approx(np.median(rms(np.array([[1.0 + n for n in range(8)], [1.0 + n for n in range(4, 12)]]))))
    # what is left of the state is the other group's
    assert rows.where("group_id = 'b'").count() == 2

"""Table functions in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel.functions import udtfs
from spectrel.operators import framing as fr


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = [(g, p, i, float(v)) for g in "ab" for p, n in (("L", 50), ("H", 17), ("X", 3)) for i, v in enumerate(rng.standard_normal(n))]
    udtfs.register(spark, {"scaled": lambda x, k: x * k, "shorter": lambda x, k: x[1:]})
    return spark.createDataFrame(rows, "group_id string, part string, n long, x double").repartition(5)


@pytest.mark.parametrize("size,hop", [(16, 8), (8, 8), (5, 9), (7, 1), (60, 1)])
def test_frames_equal_framed(spark, samples, size, hop):
    sql = f"SELECT * FROM frames(TABLE(SELECT * FROM {{s}}) PARTITION BY (group_id, part) ORDER BY (n), {size}, {hop})"
    got = spark.sql(sql, s=samples)
    assert got.columns == ["group_id", "part", "idx", "n", "m", "x"]
    want = fr.framed(samples, size, hop).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_perturbations(spark, samples):
    got = spark.sql("SELECT * FROM scaled(TABLE(SELECT * FROM {s}) PARTITION BY (group_id, part) ORDER BY (n), 3)", s=samples)
    both = got.withColumnRenamed("x", "y").join(samples, ["group_id", "part", "n"])
    assert both.count() == got.count() == samples.count() and both.where("abs(y - 3 * x) > 1e-12").count() == 0
    with pytest.raises(Exception, match="keeps the number"):
        spark.sql("SELECT * FROM shorter(TABLE(SELECT * FROM {s}) PARTITION BY (group_id, part) ORDER BY (n), 3)", s=samples).collect()


def test_calls_are_checked(spark, samples):
    for call, said in (("TABLE(SELECT * FROM {s}) PARTITION BY (group_id) ORDER BY (n), 0, 8", "size is a positive"), ("TABLE(SELECT group_id, x FROM {s}) PARTITION BY (group_id) ORDER BY (x), 4, 8", "lacks n"), ("3, 4, 8", "TABLE")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM frames({call})", s=samples).collect()
    with pytest.raises(Exception, match="missing or out of order"):
        spark.sql("SELECT * FROM frames(TABLE(SELECT * FROM {s}) PARTITION BY (group_id, part) ORDER BY (n), 4, 4)", s=samples.where("n <> 2")).collect()
    assert spark.sql("SELECT * FROM frames(TABLE(SELECT * FROM {s}) PARTITION BY (group_id, part) ORDER BY (n), 4, 4)", s=samples.where(F.lit(False))).collect() == []

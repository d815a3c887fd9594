"""Every registered query of the engine against SQL on an independent engine, and those without SQL by their shape."""

import duckdb
import pytest

from spectrel.plans import all_queries
from spectrel.plans.registry import ORACLE, QUERIES

all_queries.load()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(df):
    cell = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name,least", [("i06_holdout_report", 1), ("i06_cross_validation", 3), ("i07_oof_scores", 50)])
def test_rows_only(spark, small, name, least):
    assert QUERIES[name](spark, small).count() >= least


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and all(map(callable, e.queries().values()))

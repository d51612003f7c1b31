"""Every registered query against its SQL oracle (DuckDB) on the smallest
generated tables, and the shape of every physical plan."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from shelfsight.plans.queries import QUERIES
from tools.oracle_check import TABLES, norm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name, capsys):
    df = E.queries()[name](spark, SF)
    df.explain()
    plan = capsys.readouterr().out
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name}: {bad} in plan"
    got = df.toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no oracle")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    # same pandas form on both sides (a NULL integer would not be)
    assert {c: str(t) for c, t in got.dtypes.items()} == {c: str(t) for c, t in want.dtypes.items()}
    assert len(got) == len(want)
    assert norm(got) == norm(want)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "OOS_days" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())

"""Every registered query against its oracle SQL (or, without one, for rows and a stable schema)."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
RUNS, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(RUNS)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["from_state", "to_state", "cnt", "p"] and not df.isEmpty()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_oracle(spark, con, name):
    assert compare(RUNS[name](spark, FOLDER), con, SQLS[name]) is None


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQLS)))
def test_runs(spark, name):
    assert RUNS[name](spark, FOLDER).count() > 0

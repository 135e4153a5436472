"""Every registered query against its SQL on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    df = entry.entry(spark)
    assert df.columns == ["candidate", "cohort", "metric", "num", "den", "rate", "ci_low", "ci_high", "na_reason"]
    assert df.count() == 2 * 6 * 15


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert ok, note

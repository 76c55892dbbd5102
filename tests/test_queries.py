"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from oracle import compare, connect

SQL = entry.oracle_sql()
# Whole runs of several fits; they are run once, by test_models.
SLOW = {"validation_run", "evaluation_results", "evaluate_together", "random_search", "check_cascade", "flagged_cases", "screen_gain"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() >= 0

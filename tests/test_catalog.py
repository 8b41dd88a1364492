"""Every query with a SQL check against DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()
SLOW = {"score_batch_settled"}  # trains a forest; tests/test_ml.py covers it


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(set(CHECKS) - SLOW))
def test_query(spark, con, name):
    problems = differences(entry.queries()[name](spark, FOLDER), con, CHECKS[name])
    assert [p for p in problems if not p.startswith("note")] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(entry.queries())

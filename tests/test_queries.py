"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, SF)
    assert not verdict.startswith("FAIL"), verdict


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["repo", "findings", "high", "medium", "risk_score", "label"] and out.count() > 0

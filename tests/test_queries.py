"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, duck, name):
    ok, text = oracle.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from oracle_check import compare, duck

from catalogwatch.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


# Rows may legitimately be missing at the smallest size (nothing to report).
MAY_BE_EMPTY = {"no rows", None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], SF) in MAY_BE_EMPTY
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

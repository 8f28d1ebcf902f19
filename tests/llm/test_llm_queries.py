"""Every registered query runs on the smallest tables; those with an SQL twin equal it."""

import pytest
from oracle_check import compare, duck

from catalogwatch.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_twin(spark, name):
    assert compare(spark, duck(SF), q.QUERIES[name], q.ORACLES[name], SF) is None


def test_all_operators_and_the_pipeline():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names

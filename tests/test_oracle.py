"""Every query of the core that has SQL, against DuckDB on the same tables; the others run."""

import pytest

import forumlake.plans.archive as archive
import forumlake.plans.forum as forum
import forumlake.plans.problems as problems
from tests.oracle import assert_same, connect

QUERIES, ORACLES = forum.QUERIES | archive.QUERIES | problems.QUERIES, forum.ORACLES | archive.ORACLES | problems.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in ORACLES:
        assert_same(spark, con, sf, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, sf).count() >= 0


def test_entry_has_core_queries():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())

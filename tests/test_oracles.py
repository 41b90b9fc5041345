import pytest

from concord.plans.registry import ORACLES, QUERIES
from tests.oracle import SF, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).collect() is not None

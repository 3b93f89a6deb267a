import pytest
from compare import DATA, connect, rows

from quire.plans import catalogue, knowledge, stores  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, DATA).toPandas()
    wanted = connect().execute(ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

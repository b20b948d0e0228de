import pytest

from lodestrata.llm import queries
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, data, con, name):
    check(spark, con, queries.QUERIES[name], queries.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0

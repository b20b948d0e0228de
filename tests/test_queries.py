import pytest

from lodestrata.plans import registry
from tests.compare import check, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, data, con, name):
    check(spark, con, registry.QUERIES[name], registry.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0

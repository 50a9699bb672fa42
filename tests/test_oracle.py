import pytest

from tests.oracle import connect, same
from veldra.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, folder, name):
    same(spark, con, folder, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0

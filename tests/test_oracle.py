"""Each query of the core against its SQL twin."""

import pytest

from loomline.plans import catalogue
from tests.oracle import compare, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    assert compare(QUERIES[name](spark, data), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0

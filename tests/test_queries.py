import pytest

import __spark_entry__ as entry
from graphspark import catalog

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = list(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert compare(spark, con, name, query, sql, SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

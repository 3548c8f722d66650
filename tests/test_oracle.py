"""Every registered query against DuckDB over the same tables."""

import pytest

from lectern.plans.catalog import QUERIES
from lectern.plans.oracles import ORACLES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = connect(sf_dir)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry_has_rows(spark):
    import __spark_entry__

    result = __spark_entry__.entry(spark)
    assert result.count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

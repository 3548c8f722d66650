"""Every corpus query that SQL can express against DuckDB over the same tables."""

import pytest

from lectern.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    connection = connect(sf_dir)
    assert differences(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) == []
    connection.close()

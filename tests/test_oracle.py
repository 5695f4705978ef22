"""Every query that SQL can express equals DuckDB on the smallest tables."""

import pytest

from tidemark import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, agree):
    agree(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(name, spark):
    from conftest import SF

    assert registry.QUERIES[name](spark, SF).count() > 0

import pytest

from hemerion.llm import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert same(queries.QUERIES[name], queries.ORACLES[name], spark, sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    assert rows.count() == rows.distinct().count() > 0

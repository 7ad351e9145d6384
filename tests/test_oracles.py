"""Every registered core query with SQL gives the same rows as the SQL."""

import pytest

from hemerion.plans import core_queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(core_queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert same(core_queries.QUERIES[name], core_queries.ORACLES[name], spark, sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert core_queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

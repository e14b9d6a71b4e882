"""Every core query with SQL gives the same rows as DuckDB."""

import oracle_tools
import pytest

from lexloom.plans import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, oracle_tools.DATA).toPandas()
    assert oracle_tools.difference(got, oracle_tools.run_sql(oracle.SQL[name])) == ""


def test_all_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_queries_without_sql_run(spark, name):
    assert queries.QUERIES[name](spark, oracle_tools.DATA).count() >= 0

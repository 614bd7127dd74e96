"""Every query that SQL can express, against DuckDB."""

import pytest

from gaugeworks.llm.queries import ORACLE_SQL, QUERIES

from oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])

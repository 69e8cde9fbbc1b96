"""Queries that SQL can express against DuckDB."""

import pytest
from sqlcheck import oracle, same

from ringweave.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf).toPandas(), oracle(SQL[name], sf))

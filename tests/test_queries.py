"""Every query of the engine's own operators against its SQL."""

import pytest
from sqlcheck import oracle, same

from ringweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf).toPandas(), oracle(registry.SQL[name], sf))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_can_be_listed_without_a_session():
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True).returncode == 0

"""How much work a row makes, and how many tasks share it."""

from pyspark.sql import functions as F

from ringweave.functions import exprs as E
from ringweave.plans import facts, registry
from ringweave.sources import quality


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_is_not_parsed_for_each_count(spark):
    calls = lambda df: df._jdf.queryExecution().optimizedPlan().toJSON().count("XPath")
    xml = F.concat(F.lit("<a><testsuite tests='"), F.col("id"), F.lit("'/></a>"))
    got = spark.range(1).select(quality.junit_counts(xml).alias("j")).select("j.*")
    assert 0 < calls(got) < len(quality.COUNTS)


def test_a_row_is_grouped_once(spark):
    got = spark.range(1).select(E.marker_offsets(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("o"))
    assert plan(got).count("aggregate(") == 1


def test_trade_edges_are_read_from_where_they_are_stored(spark, sf):
    edges = facts.trade_edges(spark, sf)
    assert edges.count() > 0 and "Join" not in plan(edges)


def test_small_rows_with_much_work_are_dealt_to_many_tasks(spark, sf):
    for name in ("csharp_graph", "junit_counts", "test_source", "marker_offsets"):
        assert "RepartitionByExpression" in plan(registry.QUERIES[name](spark, sf))

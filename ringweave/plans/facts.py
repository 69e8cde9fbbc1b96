"""The run-level fact table and the graphs that the driver's tables stand in for, in Spark and in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import derive_outcomes
from ..session import stored

BASELINE, SELECTED = "R", "A"


def register(queries: dict, sql: dict, text: str | None = None) -> Callable:
    """Enter a query under its function's name, with its SQL."""

    def put(f):
        queries[f.__name__] = f
        if text:
            sql[f.__name__] = text
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each line item: its flag is the mode, its supplier the cycle, the supplier's nation the repository."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("repo"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "repo")
    bit = lambda c: c.cast("int")
    c = F.col
    return table(spark, sf_dir, "lineitem").join(supplier, c("l_suppkey") == c("s_suppkey")).select(
        c("l_returnflag").alias("mode_id"),
        F.concat(F.lit("mode "), "l_returnflag").alias("mode_label"),
        "repo",
        F.concat(F.lit("scc_"), (c("l_suppkey") % 7).cast("string"), F.lit("_cycle_"), c("l_suppkey").cast("string")).alias("cycle_id"),
        F.when(c("s_nationkey") % 2 == 0, "python").otherwise("csharp").alias("language"),
        (c("l_suppkey") % 8 + 2).cast("int").alias("cycle_size"),
        bit(c("l_tax") < 0.07).alias("structurally_evaluable"),
        bit(c("l_quantity") > 20).alias("behavior_preserved"),
        bit(c("l_discount") < 0.06).alias("cycle_eliminated_raw"),
        bit(c("l_linenumber") % 4 == 0).alias("structural_improvement_raw"),
        bit((c("l_linenumber") % 4).isin(1, 2)).alias("weakening_improvement_raw"),
        (c("l_partkey") % 5).alias("baseline_global_redundancy"),
        (c("l_partkey") % 7).alias("post_global_redundancy"),
        bit(c("l_partkey") % 11 == 0).alias("global_regression_outside_target_raw"),
        bit((c("l_partkey") % 7 > c("l_partkey") % 5) | (c("l_partkey") % 11 == 0)).alias("global_structural_regression_raw"),
        F.when(c("l_linenumber") != 7, c("l_partkey") % 6 + 1).alias("files_modified"),
        F.when(c("l_linenumber") != 7, F.floor("l_extendedprice").cast("long")).alias("chars_changed"),
        F.when(c("l_returnflag") != "N", c("l_partkey") % 997).alias("explanation_chars"),
        c("l_tax").alias("cost"),
        (c("l_suppkey") % 30 / 10.0).alias("cycle_centrality"),
        (c("l_suppkey") % 70).alias("baseline_scc_size"),
        (c("s_nationkey") * 17).cast("long").alias("repo_dependency_graph_size"),
        (c("l_suppkey") % 130).alias("cycle_external_edges"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_outcomes(raw_runs(spark, sf_dir))


FACTS_SQL = """
WITH raw AS (
  SELECT l_returnflag AS mode_id, 'mode ' || l_returnflag AS mode_label, n_name AS repo,
    'scc_' || (l_suppkey % 7) || '_cycle_' || l_suppkey AS cycle_id,
    CASE WHEN s_nationkey % 2 = 0 THEN 'python' ELSE 'csharp' END AS language,
    (l_suppkey % 8 + 2)::INTEGER AS cycle_size,
    (l_tax < 0.07::DOUBLE)::INTEGER AS structurally_evaluable, (l_quantity > 20)::INTEGER AS behavior_preserved,
    (l_discount < 0.06::DOUBLE)::INTEGER AS cycle_eliminated_raw, (l_linenumber % 4 = 0)::INTEGER AS structural_improvement_raw,
    (l_linenumber % 4 IN (1, 2))::INTEGER AS weakening_improvement_raw, l_partkey % 5 AS baseline_global_redundancy,
    l_partkey % 7 AS post_global_redundancy, (l_partkey % 11 = 0)::INTEGER AS global_regression_outside_target_raw,
    (l_partkey % 7 > l_partkey % 5 OR l_partkey % 11 = 0)::INTEGER AS global_structural_regression_raw,
    CASE WHEN l_linenumber <> 7 THEN l_partkey % 6 + 1 END AS files_modified,
    CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice)::BIGINT END AS chars_changed,
    CASE WHEN l_returnflag <> 'N' THEN l_partkey % 997 END AS explanation_chars, l_tax AS cost,
    (l_suppkey % 30) / 10.0::DOUBLE AS cycle_centrality, l_suppkey % 70 AS baseline_scc_size,
    (s_nationkey * 17)::BIGINT AS repo_dependency_graph_size, l_suppkey % 130 AS cycle_external_edges
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), broken AS (
  SELECT *, (behavior_preserved = 1 AND cycle_eliminated_raw = 1)::INTEGER AS cycle_broken,
    (behavior_preserved = 1 AND structurally_evaluable = 1 AND (structural_improvement_raw = 1 OR weakening_improvement_raw = 1))::INTEGER AS local_improvement,
    (structurally_evaluable <> 1)::INTEGER AS other_incomplete
  FROM raw
), facts AS (
  SELECT *, (cycle_broken = 1 AND local_improvement = 1 AND global_structural_regression_raw <> 1)::INTEGER AS success FROM broken
)
"""


def sql_pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN round_even(100.0::DOUBLE * {part} / {whole}, 1) END"


def trade_edges(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """For each region a graph of nations: from a customer's nation to the k supplier nations of the region that send
    it most line items.

    The edges, k for a nation, are stored: what is asked of a graph reads them many times, and the line items once.
    """
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = (
        items.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    )
    a = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src"), F.col("n_regionkey").alias("graph_id"))
    b = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("r2"))
    near = pairs.join(a, "c_nationkey").join(b, "s_nationkey").where("graph_id = r2 and c_nationkey <> s_nationkey")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey"))
    return stored(near.withColumn("p", place).where(F.col("p") <= k).select(F.col("graph_id").cast("string").alias("graph_id"), "src", "dst"), "trade-edges")


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of users: from the user of a purchase to that of the next purchase of the same day."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    # purchases follow each other within a day, so that no window spans the whole table
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    nxt = e.select(F.lit("events").alias("graph_id"), F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return nxt.where("dst is not null and src <> dst").distinct()


TRADE_SQL = """
WITH RECURSIVE pairs AS (
  SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), edges AS (
  SELECT graph_id, src, dst FROM (
    SELECT a.n_regionkey::VARCHAR AS graph_id, a.n_name AS src, b.n_name AS dst,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s_nationkey) AS p
    FROM pairs JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
    WHERE a.n_regionkey = b.n_regionkey AND c_nationkey <> s_nationkey) WHERE p <= 2
)
"""
REACH_SQL = TRADE_SQL + """, reach AS (
  SELECT graph_id, src AS a, dst AS b FROM edges
  UNION SELECT r.graph_id, r.a, e.dst FROM reach r JOIN edges e ON r.graph_id = e.graph_id AND r.b = e.src
), members AS (
  SELECT x.graph_id, x.a AS node, least(x.a, min(x.b)) AS comp
  FROM reach x JOIN reach y ON x.graph_id = y.graph_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.graph_id, x.a
)
"""

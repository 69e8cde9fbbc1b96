"""Evaluation of runs against their baselines: behaviour, structure, outcomes, difficulty, the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..session import stored
from . import graph as G

COUNTS = ("tests", "failures", "errors", "skipped")


def passed(block: str) -> Column:
    n = lambda c: F.coalesce(F.col(f"{block}.{c}"), F.lit(0))
    return F.greatest(F.lit(0), n("tests") - n("failures") - n("errors") - n("skipped"))


def test_counts(metrics: DataFrame, key: str = "run_id") -> DataFrame:
    """Counts of a metrics document (``pytest`` before ``dotnet_test``); nulls where it has neither block."""
    block = F.coalesce("pytest", "dotnet_test").alias("t")
    own = metrics.select(key, block)
    return own.select(key, *[F.when(F.col("t").isNotNull(), F.coalesce(F.col(f"t.{c}"), F.lit(0))).alias(c) for c in COUNTS], F.when(F.col("t").isNotNull(), passed("t")).alias("passed"))


def behavior_preserved(base: str, post: str) -> Column:
    """No more failures, errors and skips and no fewer passes than before; false where either is unknown."""
    le = lambda c: F.col(f"{post}.{c}") <= F.col(f"{base}.{c}")
    ok = le("failures") & le("errors") & le("skipped") & (F.col(f"{post}.passed") >= F.col(f"{base}.passed"))
    return F.coalesce(ok, F.lit(False))


def component_redundancy(edges: DataFrame, members: DataFrame) -> DataFrame:
    """graph_id, comp, redundancy: edges inside a component beyond its number of nodes, at least 0."""
    m = G.induced_edges(edges, members).groupBy("graph_id", "comp").agg(F.count("*").alias("m"))
    n = members.groupBy("graph_id", "comp").agg(F.count("*").alias("n"))
    return n.join(m, ["graph_id", "comp"], "left").select("graph_id", "comp", F.greatest(F.lit(0), F.coalesce("m", F.lit(0)) - F.col("n")).cast("long").alias("redundancy"))


def report_redundancy(sccs: DataFrame) -> DataFrame:
    """Sum of redundancies of a report's components (graph_id, size, edge_count, self_loop), cyclic ones only."""
    cyclic = (F.col("size") > 1) | ((F.col("size") == 1) & F.col("self_loop"))
    return sccs.groupBy("graph_id").agg(F.sum(F.when(cyclic, F.greatest(F.lit(0), F.col("edge_count") - F.col("size"))).otherwise(0)).cast("long").alias("redundancy"))


def cycle_eliminated(cycle_edges: DataFrame, post_edges: DataFrame) -> DataFrame:
    """Runs (run_id) of which at least one cycle edge (run_id, post_graph, src, dst) is gone from the graph after."""
    there = post_edges.select(F.col("graph_id").alias("post_graph"), "src", "dst").distinct()
    return cycle_edges.join(there, ["post_graph", "src", "dst"], "left_anti").select("run_id").distinct()


def overlapping_components(targets: DataFrame, post_members: DataFrame) -> DataFrame:
    """Components after a run that share a node with its target (run_id, post_graph, node): run_id, post_graph, comp."""
    m = post_members.select(F.col("graph_id").alias("post_graph"), "node", "comp")
    return targets.join(m, ["post_graph", "node"]).select("run_id", "post_graph", "comp").distinct()


def outside_target(runs: DataFrame, base_cyclic: DataFrame, post_cyclic: DataFrame, targets: DataFrame) -> DataFrame:
    """Runs with a cyclic node after that was neither in the target nor cyclic before."""
    now = runs.select("run_id", "graph_id", "post_graph").join(post_cyclic.select(F.col("graph_id").alias("post_graph"), "node"), "post_graph")
    new = now.join(base_cyclic.select("graph_id", "node"), ["graph_id", "node"], "left_anti").join(targets.select("run_id", "node"), ["run_id", "node"], "left_anti")
    return new.select("run_id").distinct()


def structural_metrics(runs: DataFrame, base_sccs: DataFrame, base_catalog: DataFrame, post_edges: DataFrame, post_sccs: DataFrame) -> DataFrame:
    """Structural flags of all runs, by set operations over all of them at once.

    runs: run_id, graph_id, post_graph, cycle_id, no_change and has_graph, has_report, has_catalog, has_post_report,
    has_post_graph (booleans). base_sccs, post_sccs (reports): graph_id, scc_id, size, edge_count, self_loop, nodes.
    base_catalog: graph_id, cycle_id, edges. post_edges: graph_id, src, dst, self-loops included.

    A run without the needed artifacts, with an odd cycle_id or an unknown component keeps the defaults; a run that
    changed nothing and has no graph after counts as unchanged.
    """
    normal = F.col("has_report") & F.col("has_catalog") & F.col("has_post_report") & F.col("has_post_graph")
    unchanged = F.col("no_change") & F.col("has_graph") & F.col("has_report") & F.col("has_catalog")
    r = runs.withColumns({"normal": normal, "same": unchanged & ~normal, "scc_id": E.scc_of_cycle("cycle_id")})
    target = r.join(
        base_sccs.select("graph_id", "scc_id", F.col("nodes").alias("target"), F.greatest(F.lit(0), F.col("edge_count") - F.col("size")).cast("long").alias("base_local")),
        ["graph_id", "scc_id"],
        "left",
    ).where("size(target) > 0")
    nodes = target.where("normal").select("run_id", "post_graph", F.explode("target").alias("node"))
    edges = (
        target.where("normal").join(base_catalog.select("graph_id", "cycle_id", "edges"), ["graph_id", "cycle_id"])
        .select("run_id", "post_graph", F.explode("edges").alias("e")).select("run_id", "post_graph", F.col("e.source").alias("src"), F.col("e.target").alias("dst"))
    )
    members = stored(G.strong_components(post_edges, self_loops=True), "members-after")
    near = overlapping_components(nodes, members)
    local = (
        near.join(component_redundancy(post_edges, members).withColumnRenamed("graph_id", "post_graph"), ["post_graph", "comp"])
        .groupBy("run_id").agg(F.count("*").alias("comps"), F.sum("redundancy").alias("post_local"))
    )
    cyclic = lambda s: s.where("size > 1 or self_loop").select("graph_id", F.explode("nodes").alias("node")).distinct()
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    out = (
        r.join(target.select("run_id", "base_local"), "run_id", "left")
        .join(mark(cycle_eliminated(edges, post_edges), "gone"), "run_id", "left")
        .join(local, "run_id", "left")
        .join(mark(outside_target(target.where("normal"), cyclic(base_sccs), cyclic(post_sccs), nodes), "outside"), "run_id", "left")
        .join(report_redundancy(base_sccs).withColumnRenamed("redundancy", "base_red"), "graph_id", "left")
        .join(report_redundancy(post_sccs).select(F.col("graph_id").alias("post_graph"), F.col("redundancy").alias("post_red")), "post_graph", "left")
    )
    full, held = F.col("normal") & F.col("base_local").isNotNull(), F.col("same") & F.col("base_local").isNotNull()
    comps, post_local = F.coalesce("comps", F.lit(0)), F.coalesce("post_local", F.lit(0))
    less = post_local < F.col("base_local")
    yes = lambda c: F.coalesce(full & c, F.lit(False))
    outside = F.coalesce("outside", F.lit(False))
    base_red, post_red = F.coalesce("base_red", F.lit(0)), F.coalesce("post_red", F.lit(0))
    count = lambda c: F.when(full, c).when(held, base_red).otherwise(0).cast("long")
    return out.select(
        "run_id",
        (F.col("normal") | unchanged).alias("structurally_evaluable"),
        yes(F.coalesce("gone", F.lit(False))).alias("cycle_eliminated_raw"),
        yes((comps != 1) & less).alias("structural_improvement_raw"),
        yes((comps == 1) & less).alias("weakening_improvement_raw"),
        yes((post_red > base_red) | outside).alias("global_structural_regression_raw"),
        yes(outside).alias("global_regression_outside_target_raw"),
        F.when(full | held, F.col("base_local")).otherwise(0).alias("baseline_local_redundancy"),
        F.when(full, post_local).when(held, F.col("base_local")).otherwise(0).alias("post_local_redundancy"),
        count(base_red).alias("baseline_global_redundancy"),
        count(post_red).alias("post_global_redundancy"),
    )


def derive_outcomes(runs: DataFrame) -> DataFrame:
    """Outcome flags (0/1) of runs with raw flags: cycle_broken, local_improvement, success, other_incomplete."""
    kept, evaluable = F.col("behavior_preserved") == 1, F.col("structurally_evaluable") == 1
    broken = kept & (F.col("cycle_eliminated_raw") == 1)
    local = kept & evaluable & ((F.col("structural_improvement_raw") == 1) | (F.col("weakening_improvement_raw") == 1))
    success = broken & local & (F.col("global_structural_regression_raw") != 1)
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return runs.withColumns(
        {"cycle_broken": bit(broken), "local_improvement": bit(local), "success": bit(success), "other_incomplete": bit(~evaluable)}
    )


def difficulty_metrics(cycles: DataFrame, edges: DataFrame, declared: DataFrame, sccs: DataFrame) -> DataFrame:
    """Structural difficulty of each distinct cycle: centrality, size of its component and graph, external edges.

    cycles: graph_id, cycle_id, nodes. PageRank is computed once for each graph.
    """
    one = cycles.dropDuplicates(["graph_id", "cycle_id"])
    nodes = G.graph_nodes(edges, declared)
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("repo_dependency_graph_size"))
    ranks = G.pagerank(edges, nodes)
    named = one.withColumn("scc_id", E.scc_of_cycle("cycle_id"))
    return (
        named.select("graph_id", "cycle_id", "scc_id")
        .join(G.relative_centrality(one, ranks).withColumnRenamed("centrality", "cycle_centrality"), ["graph_id", "cycle_id"], "left")
        .join(sccs.select("graph_id", "scc_id", F.col("size").alias("baseline_scc_size")), ["graph_id", "scc_id"], "left")
        .join(size, "graph_id", "left")
        .join(G.external_edges(edges, one).withColumnRenamed("external_edges", "cycle_external_edges"), ["graph_id", "cycle_id"], "left")
        .drop("scc_id")
    )


def all_runs(planned: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The fact table: planned runs with their evaluation, in display order. A run without one is an error."""
    joined = planned.join(evaluated, "run_id", "left")
    checked = joined.withColumn("structurally_evaluable", F.when(F.col("structurally_evaluable").isNull(), F.raise_error(F.concat(F.lit("no results of run "), F.col("run_id").cast("string")))).otherwise(F.col("structurally_evaluable")))
    return derive_outcomes(checked).orderBy("mode_order", "repo", "cycle_id", "experiment_id")

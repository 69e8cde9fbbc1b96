"""Sinks: tables as CSV, documents as JSON, selections as text, logs as JSON lines."""

from __future__ import annotations

import os
import shutil
import tarfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators.tables import HEADERS


def titled(table: DataFrame) -> DataFrame:
    """A result table with the column titles of files."""
    return table.withColumnsRenamed({c: HEADERS[c] for c in table.columns if c in HEADERS})


def write_csv(df: DataFrame, path: str, titles: bool = False, single: bool = True) -> None:
    """CSV with a header; result tables are small and go to one file."""
    out = titled(df) if titles else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A document for each row."""
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _document(*parts: Column) -> Column:
    """A JSON document; what is unknown is there as null."""
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("doc")


def _known(df: DataFrame, info: DataFrame | None, names: list[str]) -> DataFrame:
    """``df`` with the columns ``names`` of ``info`` (a row for each graph_id); null where they aren't there."""
    there = [] if info is None else [c for c in names if c in info.columns]
    own = df if not there else df.join(info.select("graph_id", *there), "graph_id", "left")
    return own.withColumns({c: F.lit(None).cast("string") for c in names if c not in there})


def _edge(edges: DataFrame) -> Column:
    relation = F.col("relation") if "relation" in edges.columns else F.lit("import")
    return F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), relation.alias("relation"))


EDGES = "array<struct<source:string,target:string,relation:string>>"


def graph_documents(nodes: DataFrame, edges: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """graph_id, doc: the dependency graph document of each graph, nodes and edges sorted and each there once.

    nodes: graph_id, node and abs_path if known; edges: graph_id, src, dst and relation (else ``import``);
    ``info``: graph_id and, if known, language, repo_root, entry.
    """
    path = F.min("abs_path") if "abs_path" in nodes.columns else F.lit(None).cast("string")
    one = nodes.groupBy("graph_id", "node").agg(path.alias("abs_path"))
    n = one.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("id"), F.lit("file").alias("kind"), "abs_path"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_set(_edge(edges))).alias("edges"))
    both = _known(n.join(e, "graph_id", "left"), info, ["language", "repo_root", "entry"])
    return both.select(
        "graph_id",
        _document(
            F.lit(1).alias("schema_version"), F.col("language"), F.col("repo_root"), F.col("entry"), F.col("nodes"), F.coalesce("edges", F.array().cast(EDGES)).alias("edges")
        ),
    )


def _number(name: str) -> Column:
    """The number at the end of a name, so that scc_10 comes after scc_2."""
    return F.regexp_extract(name, "(\\d+)$", 1).try_cast("long")


def report_documents(
    sccs: DataFrame,
    inside: DataFrame,
    totals: DataFrame,
    ranks: DataFrame,
    graphs: DataFrame,
    info: DataFrame | None = None,
    params: tuple[float, int, float] = (0.85, 100, 1e-6),
    at: Column | None = None,
) -> DataFrame:
    """graph_id, doc: the component report of each graph, larger components first.

    sccs: ``graph.scc_metrics``; inside: ``graph.induced_edges``; totals: ``graph.scc_global``; ranks: graph_id,
    node, rank; graphs: graph_id, node_count, edge_count; ``info``: graph_id and, if known, input_schema_version,
    dependency_graph, language, repo_root, entry. ``params``: alpha, rounds and tolerance of the ranks. A graph
    without cyclic components has an empty report. Lines of code that are unknown count as none.
    """
    e = inside.groupBy("graph_id", "comp").agg(F.array_sort(F.collect_set(_edge(inside))).alias("edges"))
    loc = {c: F.lit(0).cast(t) for c, t in (("total_loc", "long"), ("avg_loc_per_node", "double")) if c not in sccs.columns}
    full = sccs.withColumns(loc).join(e, ["graph_id", "comp"], "left")
    nodes = F.transform("nodes", lambda x: F.struct(x.alias("id"), F.lit("file").alias("kind"))).alias("nodes")
    own = F.struct(
        F.col("scc_id").alias("id"), "size", "edge_count", "density_directed", "edge_surplus_lb", "total_loc", "avg_loc_per_node", nodes, F.coalesce("edges", F.array().cast(EDGES)).alias("edges")
    )
    s = full.groupBy("graph_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(_number("scc_id").alias("_o"), own.alias("s")))), lambda x: x["s"]).alias("sccs"), F.sum("total_loc").alias("_loc")
    )
    f = ranks.groupBy("graph_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", F.struct(F.col("rank").alias("pagerank")))))).alias("node_features"))
    zero = lambda c, t="long": F.coalesce(c, F.lit(0)).cast(t)
    measures = F.struct(
        zero("scc_count").alias("scc_count"),
        zero("total_nodes").alias("total_nodes_in_cyclic_sccs"),
        zero("total_edges").alias("total_edges_in_cyclic_sccs"),
        zero("_loc").alias("total_loc_in_cyclic_sccs"),
        zero("max_scc_size").alias("max_scc_size"),
        zero("avg_scc_size", "double").alias("avg_scc_size"),
        zero("cycle_pressure_lb").alias("cycle_pressure_lb"),
    )
    given = ["input_schema_version", "dependency_graph", "language", "repo_root", "entry"]
    every = _known(graphs.join(totals, "graph_id", "left").join(s, "graph_id", "left").join(f, "graph_id", "left"), info, given)
    return every.select(
        "graph_id",
        _document(
            F.lit(1).alias("schema_version"),
            E.utc_text(F.current_timestamp() if at is None else at).alias("generated_at_utc"),
            F.struct(F.col("input_schema_version").cast("int").alias("schema_version"), *given[1:]).alias("input"),
            F.struct(F.col("node_count").cast("long").alias("node_count"), F.col("edge_count").cast("long").alias("edge_count")).alias("graph"),
            F.struct(F.lit(params[0]).alias("pagerank_alpha"), F.lit(params[1]).alias("pagerank_max_iter"), F.lit(params[2]).alias("pagerank_tol")).alias("params"),
            measures.alias("global_metrics"),
            F.coalesce("node_features", F.create_map().cast("map<string,struct<pagerank:double>>")).alias("node_features"),
            F.coalesce("sccs", F.array().cast(s.schema["sccs"].dataType)).alias("sccs"),
        ),
    )


def catalog_documents(catalog: DataFrame, sccs: DataFrame, info: DataFrame | None = None, params: tuple[int, int, int, int] = (8, 50_000, 200, 12_345), at: Column | None = None) -> DataFrame:
    """graph_id, doc: the cycle catalog of each graph that has cyclic components, those without a cycle included.

    catalog: ``graph.cycle_catalog``; sccs: ``graph.scc_metrics``; ``info``: graph_id and, if known,
    dependency_graph, scc_report, repo, base_branch. ``params``: longest cycle, walks and cycles of a component, seed.
    """
    ring = F.transform("edges", lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), F.lit("import").alias("relation"))).alias("edges")
    c = F.struct(F.col("cycle_id").alias("id"), "length", "nodes", ring, F.struct("pagerank_avg", "pagerank_min", "pagerank_max").alias("metrics"))
    per = catalog.groupBy("graph_id", "scc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(_number("cycle_id").alias("_o"), c.alias("c")))), lambda x: x["c"]).alias("cycles"))
    all_of = sccs.select("graph_id", "scc_id", F.col("size").alias("node_count"), "edge_count").join(per, ["graph_id", "scc_id"], "left")
    own = F.struct(F.col("scc_id").alias("id"), "node_count", "edge_count", F.coalesce("cycles", F.array().cast(per.schema["cycles"].dataType)).alias("cycles"))
    s = all_of.groupBy("graph_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(_number("scc_id").alias("_o"), own.alias("s")))), lambda x: x["s"]).alias("sccs"),
        F.sum(F.coalesce(F.size("cycles"), F.lit(0))).alias("n"),
    )
    given = ["dependency_graph", "scc_report", "repo", "base_branch"]
    names = ("max_cycle_len", "attempts_per_scc", "max_cycles_per_scc", "seed")
    return _known(s, info, given).select(
        "graph_id",
        _document(
            F.lit(1).alias("schema_version"),
            E.utc_text(F.current_timestamp() if at is None else at).alias("generated_at_utc"),
            F.struct(*given).alias("input"),
            F.struct(*[F.lit(v).alias(k) for k, v in zip(names, params)]).alias("params"),
            F.struct(F.size("sccs").alias("scc_count"), F.greatest(F.col("n"), F.lit(0)).alias("cycle_count")).alias("summary"),
            F.col("sccs"),
        ),
    )


def write_selection(selection: DataFrame, path: str) -> None:
    """``repo branch cycle_id`` lines in the order of choice."""
    selection.coalesce(1).sortWithinPartitions("pick_no").select(F.concat_ws(" ", "repo", "base_branch", "cycle_id").alias("value")).write.mode("overwrite").text(path)


def metrics_document(language: Column | str, tests: Column, **blocks: Column) -> Column:
    """A metrics document: the tests under their language's name, and further blocks."""
    python = F.lower(E.col(language)) == "python"
    own = [F.when(python, tests).alias("pytest"), F.when(~python, tests).alias("dotnet_test")]
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), E.col(language).alias("language"), *own, *[v.alias(k) for k, v in blocks.items()]))


#: Columns of the run outcome file, in order, and its names for them. Fixed values.
RUN_OUTCOMES = {
    "repo": "repo",
    "experiment_id": "experiment",
    "cycle_id": "cycle",
    "mode_id": "mode",
    "mode_label": "configuration",
    "behavior_preserved": "behavior",
    "cycle_broken": "cycle broken",
    "local_improvement": "local improvement",
    "success": "success",
    "global_structural_regression_raw": "global regression",
    "global_regression_outside_target_raw": "outside-target regression",
    "structurally_evaluable": "structural eval",
    "other_incomplete": "incomplete",
    "no_change": "no change",
    "openhands_outcome": "openhands outcome",
}


def run_outcomes(facts: DataFrame) -> DataFrame:
    """The run outcome file of a fact table; a fact table without one of its columns is an error."""
    E.require_columns(facts, list(RUN_OUTCOMES))
    return facts.select(*[F.col(c).alias(name) for c, name in RUN_OUTCOMES.items()])


#: What stays beside the archive of a folder, and the archive. Fixed names.
KEPT, ARCHIVE = "metrics.json", "raw_artifacts.tar.gz"


def archive_raw(folder: str) -> list[str]:
    """Pack all entries of a driver's folder but its metrics into an archive there, delete them, and return their names.

    An older archive is replaced; a folder with nothing to pack gets none.
    """
    names = sorted(n for n in os.listdir(folder) if n not in (KEPT, ARCHIVE))
    path = os.path.join(folder, ARCHIVE)
    if os.path.exists(path):
        os.remove(path)
    if names:
        with tarfile.open(path, "w:gz") as t:
            for n in names:
                t.add(os.path.join(folder, n), n)
    for n in names:
        own = os.path.join(folder, n)
        shutil.rmtree(own) if os.path.isdir(own) and not os.path.islink(own) else os.remove(own)
    return names

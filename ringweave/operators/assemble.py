"""From a tree of run artifacts to the fact table.

The tree is scanned once. Each file goes to the reader of its kind, which turns it into a few values or rows; a
baseline that many runs share is read once and its values fan out to the runs by joins on paths. No text travels with
a run.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..session import qualified, ship_package, stored
from ..sources.runs import outcome_of
from . import diff, evaluate

#: Kinds of artifacts, named after the columns of a plan that hold their paths.
METRICS, GRAPH, REPORT, CATALOG, STATUS, PROMPT, PATCH = "metrics_path", "graph_path", "scc_report_path", "cycle_catalog_path", "openhands_status_path", "explain_prompt_path", "diff_patch_path"
#: What a run asks for: its role, and the column of the plan.
ROLES = {
    "base_metrics": f"baseline_{METRICS}", "post_metrics": f"post_{METRICS}", "base_graph": f"baseline_{GRAPH}", "post_graph": f"post_{GRAPH}",
    "base_report": f"baseline_{REPORT}", "post_report": f"post_{REPORT}", "catalog": f"baseline_{CATALOG}", "status": STATUS, "prompt": PROMPT, "patch": PATCH,
    "folder": "branch_results_dir",
}
_COUNTS = "struct<tests:bigint,failures:bigint,errors:bigint,skipped:bigint>"
_METRICS = f"struct<pytest:{_COUNTS},dotnet_test:{_COUNTS}>"
_EDGES = "array<struct<source:string,target:string>>"
_REPORT = f"struct<sccs:array<struct<id:string,size:bigint,edge_count:bigint,nodes:array<string>,edges:{_EDGES}>>>"
OUTCOMES = (
    "openhands_outcome no_change other_incomplete structurally_evaluable behavior_preserved cycle_broken local_improvement success cycle_size cycle_eliminated_raw structural_improvement_raw "
    "weakening_improvement_raw global_structural_regression_raw global_regression_outside_target_raw baseline_global_redundancy post_global_redundancy explanation_chars files_modified chars_changed"
).split()


def _bare(path: Column | str) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def routed(files: DataFrame) -> DataFrame:
    """path, folder (the run's), kind, text of the files (path, text) that are artifacts; other files are left out."""
    kind = folder = F.lit(None).cast("string")
    for name, place in E.ARTIFACTS.items():
        end = "/" + place
        kind = F.when(F.endswith("path", F.lit(end)), name).otherwise(kind)
        folder = F.when(F.endswith("path", F.lit(end)), F.expr(f"left(path, length(path) - {len(end)})")).otherwise(folder)
    return files.select("path", folder.alias("folder"), kind.alias("kind"), "text").where("kind is not null")


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """``routed`` files of a results tree, by one scan. Paths begin with ``root`` as it is given.

    A file that isn't UTF-8 has a null text; in patches what can't be read is replaced.
    """
    names = ",".join(sorted({p.rsplit("/", 1)[-1] for p in E.ARTIFACTS.values()}))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + names + "}").load(root)
    top = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", qualified(spark, root.rstrip("/"))).rstrip("/")
    below = F.expr(f"substr(_path, {len(top) + 1})")
    own = files.select(_bare("path").alias("_path"), F.col("content").cast("string").alias("raw")).select(F.concat(F.lit(root.rstrip("/")), below).alias("path"), "raw")
    patch = F.endswith("path", F.lit("/" + E.ARTIFACTS[PATCH]))
    return routed(own.select("path", F.when(patch, F.make_valid_utf8("raw")).otherwise(F.try_validate_utf8("raw")).alias("text")))


def unreadable(files: DataFrame) -> DataFrame:
    """path and kind of JSON artifacts that aren't JSON."""
    return files.where(~F.col("kind").isin(PROMPT, PATCH) & F.try_parse_json(F.coalesce("text", F.lit(""))).isNull()).select("path", "kind")


def _counts(text: str) -> Column:
    """Counts and passes of a metrics document; null without a block of them."""
    doc = F.from_json(text, _METRICS)
    block = F.coalesce(doc["pytest"], doc["dotnet_test"])
    n = {c: F.coalesce(block[c], F.lit(0)) for c in evaluate.COUNTS}
    passed = F.greatest(F.lit(0), n["tests"] - n["failures"] - n["errors"] - n["skipped"])
    return F.when(block.isNotNull(), F.struct(*[v.alias(c) for c, v in n.items()], passed.alias("passed")))


def file_facts(files: DataFrame) -> DataFrame:
    """What one file says on its own, without its text: path, readable, outcome, counts, chars, files_modified, chars_changed."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    edges = F.get_json_object("text", "$.edges")
    own = files.select(
        "path",
        of(GRAPH, F.try_parse_json("text").isNotNull() & (edges.isNull() | edges.startswith("["))).alias("readable"),
        of(STATUS, outcome_of("text")).alias("outcome"),
        of(METRICS, _counts("text")).alias("counts"),
        of(PROMPT, E.explanation_length("text")).cast("long").alias("chars"),
        of(PATCH, F.col("text")).alias("patch"),
    )
    patched = diff.diff_footprint(own, key=F.struct("path", "readable", "outcome", "counts", "chars").alias("own"), text="patch")
    return patched.select("own.*", "files_modified", "chars_changed")


def _nodes(items: Column) -> Column:
    """Ids of nodes that are objects with an id or plain strings."""
    ids = F.transform(items, lambda x: F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.id")).otherwise(x))
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))


def report_components(files: DataFrame) -> DataFrame:
    """graph_id (the folder), scc_id, size, edge_count, self_loop, nodes of component reports.

    Missing sizes and counts are 0. Of components with the same id the first has it, and the others none.
    """
    reports = files.where(F.col("kind") == REPORT).select("folder", F.from_json("text", _REPORT).alias("doc"))
    ids = F.transform("doc.sccs", lambda s: s["id"])
    s = reports.select("folder", ids.alias("ids"), F.posexplode("doc.sccs").alias("at", "s")).where("s is not null")
    loop = F.exists(F.coalesce("s.edges", F.array().cast(_EDGES)), lambda e: e.isNotNull() & e["source"].eqNullSafe(e["target"]))
    count = lambda c: F.coalesce(f"s.{c}", F.lit(0).cast("long")).alias(c)
    first = F.array_position("ids", F.col("s.id")) == F.col("at") + 1
    nodes = F.coalesce(_nodes(F.col("s.nodes")), F.array().cast("array<string>"))
    return s.select(F.col("folder").alias("graph_id"), F.when(first, F.col("s.id")).alias("scc_id"), count("size"), count("edge_count"), loop.alias("self_loop"), nodes.alias("nodes"))


def graph_edges(files: DataFrame) -> DataFrame:
    """graph_id (the folder), src, dst: distinct edges of dependency graphs, self-loops kept."""
    docs = files.where(F.col("kind") == GRAPH).select("folder", F.explode(F.from_json("text", f"struct<edges:{_EDGES}>")["edges"]).alias("e"))
    return docs.where("e.source is not null and e.target is not null").select(F.col("folder").alias("graph_id"), F.col("e.source").alias("src"), F.col("e.target").alias("dst")).distinct()


def _records(doc, wanted: set[str]) -> dict[str, dict]:
    """The first object, depth first, with each wanted id."""
    found: dict[str, dict] = {}
    todo = [doc]
    while todo and len(found) < len(wanted):
        at = todo.pop()
        if isinstance(at, dict):
            if isinstance(at.get("id"), str) and at["id"] in wanted:
                found.setdefault(at["id"], at)
            todo += reversed(list(at.values()))
        elif isinstance(at, list):
            todo += reversed(at)
    return found


def record_edges(record: dict) -> list[tuple[str, str]] | None:
    """Edges of a cycle's record under any of its names, else those of the ring of its nodes; None without either."""
    for name in ("edges", "cycle_edges"):
        given = record.get(name) if isinstance(record.get(name), list) else []
        pairs = [(x.get("source"), x.get("target")) if isinstance(x, dict) else tuple(x) if isinstance(x, list) and len(x) == 2 else (None, None) for x in given]
        if edges := [p for p in pairs if all(isinstance(x, str) for x in p)]:
            return edges
    for name in ("nodes", "cycle_nodes", "path", "files"):
        given = record.get(name) if isinstance(record.get(name), list) else []
        ids = [x.get("id") if isinstance(x, dict) else x for x in given]
        ids = [x for x in ids if isinstance(x, str)]
        if len(ids) > 1:
            return list(zip(ids, ids[1:] + ids[:1]))
    return None


def catalog_records(files: DataFrame, planned: DataFrame) -> DataFrame:
    """graph_id (the folder), cycle_id, length, edges of the planned cycles. A catalog is parsed once for all its cycles.

    A record may stand at any depth of its catalog, which is beyond a schema.
    """
    ship_package(files.sparkSession)
    ids = planned.groupBy(F.col("baseline_results_dir").alias("folder")).agg(F.collect_set("cycle_id").alias("ids"))
    own = files.where((F.col("kind") == CATALOG) & F.col("text").isNotNull()).select("folder", "text").join(ids, "folder")

    def run(batches):
        for pdf in batches:
            rows = []
            for folder, text, wanted in zip(pdf["folder"], pdf["text"], pdf["ids"]):
                try:
                    doc = json.loads(text)
                except ValueError:
                    continue
                for name, record in _records(doc, set(wanted)).items():
                    n = record.get("length")
                    n = int(n) if isinstance(n, int) or isinstance(n, float) and n.is_integer() else None
                    edges = record_edges(record)
                    rows.append((folder, name, n, None if edges is None else [{"source": a, "target": b} for a, b in edges]))
            if rows:  # columns without rows have no type that fits
                yield pd.DataFrame({"graph_id": [r[0] for r in rows], "cycle_id": [r[1] for r in rows], "length": pd.array([r[2] for r in rows], "Int64"), "edges": [r[3] for r in rows]})

    return own.mapInPandas(run, f"graph_id string, cycle_id string, length long, edges {_EDGES}")


def run_facts(planned: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each run: for each role a struct of what its file says, null where there is no file."""
    asked = planned.select("run_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("path")) for r, c in ROLES.items()])).alias("a")).select("run_id", "a.*")
    told = asked.join(facts.withColumn("there", F.lit(True)), "path", "left")
    fields = [c for c in told.columns if c not in ("run_id", "role", "path")]
    return told.groupBy("run_id").agg(*[F.max(F.when((F.col("role") == r) & F.col("there"), F.struct(*fields))).alias(r) for r in ROLES])


def assemble_runs(planned: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """Planned runs (see ``planning.planned_runs``) with their ``OUTCOMES``, in display order.

    files: ``routed`` artifacts. A run without a folder is an error; missing files are not. A file that can't be read
    counts as there, and says nothing: no test counts, no components, no edges. ``strict`` makes such metrics, graphs,
    reports and catalogs errors. Lengths and sizes are null where their file doesn't give them.
    """
    plan = stored(planned.withColumn("run_id", F.concat_ws("\x1f", "mode_id", "experiment_id", "repo", "cycle_id")), "plan")
    paths = plan.select(F.explode(F.array(*[c for r, c in ROLES.items() if r != "folder"])).alias("path")).distinct()
    held = stored(files.join(paths, "path", "left_semi"), "artifacts")
    if strict and (bad := unreadable(held).where(F.col("kind") != STATUS).orderBy("path").first()):
        raise ValueError(f"{bad['path']} is no JSON")
    folders = files.select(F.col("folder").alias("path")).distinct()
    told = stored(run_facts(plan, file_facts(held).unionByName(folders, allowMissingColumns=True)), "run-facts")
    there = lambda role: F.col(role).isNotNull()
    runs = plan.join(told, "run_id").withColumn("run_id", F.when(there("folder"), F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("no results in "), "branch_results_dir"))))
    outcome = F.coalesce("status.outcome", F.lit(""))
    normal = there("base_report") & there("catalog") & there("post_report") & there("post_graph")
    readable = F.when(normal, F.col("post_graph.readable")).otherwise(F.coalesce("base_graph.readable", F.lit(True)))
    shape = stored(runs.select(
        "run_id", F.col("baseline_results_dir").alias("graph_id"), F.col("branch_results_dir").alias("post_graph"),
        # a graph that says nothing leaves all that is derived from it at its defaults, as an odd id does
        F.when(readable, F.col("cycle_id")).otherwise("").alias("cycle_id"), (outcome == "no_changes").alias("no_change"),
        there("base_graph").alias("has_graph"), there("base_report").alias("has_report"), there("catalog").alias("has_catalog"), there("post_report").alias("has_post_report"), there("post_graph").alias("has_post_graph"),
    ), "run-shapes")
    components, records = stored(report_components(held), "components"), stored(catalog_records(held, plan), "records")
    after = plan.select(F.col("branch_results_dir").alias("graph_id")).distinct()
    structure = evaluate.structural_metrics(shape, components, records.where("edges is not null"), graph_edges(held).join(after, "graph_id", "left_semi"), components)
    kept = evaluate.behavior_preserved("base_metrics.counts", "post_metrics.counts")
    size = records.select(F.col("graph_id").alias("baseline_results_dir"), "cycle_id", F.col("length").alias("cycle_size"))
    evaluated = runs.select(
        "run_id", outcome.alias("openhands_outcome"), (outcome == "no_changes").cast("int").alias("no_change"), kept.cast("int").alias("behavior_preserved"),
        F.col("prompt.chars").alias("explanation_chars"), F.col("patch.files_modified").alias("files_modified"), F.col("patch.chars_changed").alias("chars_changed"),
    )
    flags = [c for c, t in structure.dtypes if t == "boolean"]
    structure = structure.withColumns({c: F.col(c).cast("int") for c in flags}).drop("baseline_local_redundancy", "post_local_redundancy")
    return evaluate.all_runs(plan.join(size, ["baseline_results_dir", "cycle_id"], "left"), evaluated.join(structure, "run_id")).drop("run_id")

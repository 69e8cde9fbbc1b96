"""Planned runs and experiment units: cross products with checks of what they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E


def with_repo(cycles: DataFrame, repos: DataFrame) -> DataFrame:
    """Cycles (repo, base_branch, cycle_id) with their repository's entry and language; an unknown repository or
    another branch is an error."""
    r = repos.select("repo", F.col("base_branch").alias("_branch"), "entry", "language")
    joined = cycles.join(r, "repo", "left")
    bad = F.col("_branch").isNull() | (F.col("_branch") != F.col("base_branch"))
    text = F.concat(F.lit("cycle of an unknown repository or branch: "), F.col("repo"), F.lit(" "), F.col("base_branch"))
    return joined.withColumn("repo", F.when(bad, F.raise_error(text)).otherwise(F.col("repo"))).drop("_branch")


def planned_runs(modes: DataFrame, cycles: DataFrame, repos: DataFrame, results_root: str) -> DataFrame:
    """A row for each mode (mode_id, mode_label, mode_order, experiments), experiment and cycle, with artifact paths."""
    m = modes.select("mode_id", "mode_label", "mode_order", F.explode("experiments").alias("experiment_id"))
    rows = m.crossJoin(with_repo(cycles, repos))  # the plan itself is this product
    rows = rows.withColumn("branch_name", E.refactor_branch("experiment_id", "mode_id", "cycle_id"))
    root = F.lit(results_root)
    base = {f"baseline_{k}": E.artifact_path(root, "repo", "base_branch", k) for k in ("metrics_path", "graph_path", "scc_report_path", "cycle_catalog_path")}
    post = {f"post_{k}": E.artifact_path(root, "repo", "branch_name", k) for k in ("metrics_path", "graph_path", "scc_report_path")}
    own = {k: E.artifact_path(root, "repo", "branch_name", k) for k in ("openhands_status_path", "explain_prompt_path", "diff_patch_path")}
    dirs = {"branch_results_dir": E.artifact_path(root, "repo", "branch_name", "dir"), "baseline_results_dir": E.artifact_path(root, "repo", "base_branch", "dir")}
    return rows.withColumns({**dirs, **base, **post, **own})


def experiment_units(cycles: DataFrame, repos: DataFrame, modes: DataFrame, selected: list[str]) -> DataFrame:
    """Cycles times the selected modes, cycle by cycle; ``ord`` counts in that order."""
    own = modes.where(F.col("mode_id").isin(selected))
    rows = with_repo(cycles, repos).crossJoin(own)
    from pyspark.sql import Window

    return rows.withColumn("ord", F.row_number().over(Window.orderBy("cycle_ord", "mode_ord")) - 1)  # a plan's rows are few


MODE_PARAMS = {
    "orchestrator": {"minimal", "multi_agent"},
    "edge_variant": {"E0", "E1", "E2"},
    "synthesizer_variant": {"S0", "S1", "S2"},
    "auxiliary_agent": {"none", "boundary", "graph", "project"},
}


def mode_params(given: dict) -> dict:
    """Normalised parameters of a mode: lower or upper case as defined, unknown names or values are errors."""
    out = {}
    for name, value in given.items():
        if name not in MODE_PARAMS:
            raise ValueError(f"no such parameter: {name}")
        found = [v for v in MODE_PARAMS[name] if v.lower() == str(value).strip().lower()]
        if not found:
            raise ValueError(f"{name} can't be {value}")
        out[name] = found[0]
    if out.get("orchestrator", "minimal") == "minimal" and len(out) > (1 if "orchestrator" in out else 0):
        raise ValueError("a minimal prompt takes no variants")
    return out

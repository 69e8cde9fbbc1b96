"""The fact table from a tree of artifacts on disk."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ringweave.functions import exprs as E
from ringweave.operators import assemble, planning
from ringweave.plans import artifact_queries as Q
from ringweave.sources import config

RING = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]


def graph(edges):
    return json.dumps({"nodes": [], "edges": [{"source": a, "target": b} for a, b in edges]})


def report(*sccs):
    return json.dumps({"sccs": [{"id": f"scc_{k}", "size": len(nodes), "edge_count": n, "nodes": [{"id": x} for x in nodes], "edges": []} for k, (nodes, n) in enumerate(sccs)]})


def counted(**counts):
    return json.dumps({"pytest": {"tests": 10, **counts}})


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "all results"

    def write(repo, branch, **texts):
        for kind, text in texts.items():
            at = root / repo / "branches" / branch / E.ARTIFACTS[kind]
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(text if isinstance(text, bytes) else text.encode())

    catalog = json.dumps({"deep": [{"er": {"id": "scc_0_cycle_0", "length": 3.0, "cycle_edges": [["a", "b"], ["b", "c"], {"source": "c", "target": "a"}]}}]})
    base = {"metrics_path": counted(failures=1), "graph_path": graph(RING), "scc_report_path": report(("abc", 4)), "cycle_catalog_path": catalog}
    write("r", "main", **base)
    write("r", "atd-e-none-scc_0_cycle_0", metrics_path=counted(failures=0), graph_path=graph(RING[1:]), scc_report_path=report(("ac", 2)), openhands_status_path='{"outcome": "done"}', diff_patch_path=b"diff --git a/x b/y\n+n\xff\xc3\xa9w\n-old\n", explain_prompt_path="x " + E.EXPLANATION_ANCHOR + " \n why")
    write("r", "atd-e-adv-scc_0_cycle_0", openhands_status_path='{"outcome": " no_changes "}', metrics_path="{", explain_prompt_path=b"\xff" + E.EXPLANATION_ANCHOR.encode())
    return root, write, base


def planned(spark, root, repos=("r",)):
    modes = config.analysis_plan(spark, {"modes": [{"id": m, "label": m.upper(), "experiments": ["e"]} for m in ("none", "adv")]})
    cycles = spark.createDataFrame([(r, "main", "scc_0_cycle_0") for r in repos], "repo string, base_branch string, cycle_id string")
    rows = spark.createDataFrame([(r, "main", "src", "python") for r in repos], "repo string, base_branch string, entry string, language string")
    return planning.planned_runs(modes, cycles, rows, str(root))


def test_runs_of_a_tree(spark, tree):
    root, write, _ = tree
    files = assemble.read_results(spark, str(root))
    got = {r["mode_id"]: r.asDict() for r in assemble.assemble_runs(planned(spark, root), files).collect()}
    done, same = got["none"], got["adv"]
    assert [done[c] for c in ("success", "cycle_broken", "local_improvement", "weakening_improvement_raw", "behavior_preserved", "cycle_size")] == [1, 1, 1, 1, 1, 3]
    assert (done["explanation_chars"], done["files_modified"], done["baseline_global_redundancy"], done["post_global_redundancy"]) == (3, 2, 1, 0)
    # nothing after, but nothing changed either; its metrics and its prompt can't be read
    assert (same["no_change"], same["structurally_evaluable"], same["behavior_preserved"], same["success"], same["post_global_redundancy"]) == (1, 1, 0, 0, 1)
    assert same["explanation_chars"] is None and same["files_modified"] is None and same["openhands_outcome"] == "no_changes"
    assert sorted(r["kind"] for r in assemble.unreadable(files).collect()) == ["metrics_path"]
    with pytest.raises(ValueError, match="no JSON"):
        assemble.assemble_runs(planned(spark, root), files, strict=True)


def test_a_run_without_a_folder_is_an_error(spark, tree):
    root, write, base = tree
    write("s", "main", **base)
    with pytest.raises(Exception, match="no results in"):
        assemble.assemble_runs(planned(spark, root, ("r", "s")), assemble.read_results(spark, str(root))).collect()


def test_unreadable_graphs_and_reports_say_nothing(spark, tree):
    root, write, base = tree
    files = {"metrics_path": counted(failures=0), "scc_report_path": report(("ab", 2)), "openhands_status_path": "[]", "graph_path": graph(RING[1:])}
    for k, (before, after) in enumerate([({}, {"graph_path": '{"edges": 3}'}), ({"scc_report_path": "x"}, {}), ({"cycle_catalog_path": "x"}, {}), ({"graph_path": "x"}, {}), ({"scc_report_path": '{"sccs": 1}'}, {"scc_report_path": "{}"})]):
        write(f"q{k}", "main", **base | before)
        for mode in ("none", "adv"):
            write(f"q{k}", f"atd-e-{mode}-scc_0_cycle_0", **files | after)
    rows = {r["repo"]: r for r in assemble.assemble_runs(planned(spark, root, [f"q{k}" for k in range(5)]), assemble.read_results(spark, str(root))).where("mode_id = 'none'").collect()}
    assert [rows[f"q{k}"]["structurally_evaluable"] for k in range(5)] == [1] * 5
    assert [rows[f"q{k}"]["cycle_eliminated_raw"] for k in range(5)] == [0, 0, 0, 1, 0]
    assert [rows[f"q{k}"]["cycle_size"] for k in range(5)] == [3, 3, None, 3, 3]


def test_components_of_reports(spark):
    doc = {"sccs": [{"id": "a", "size": 1, "edge_count": 2, "nodes": ["x", {"id": "y"}, {"name": "z"}], "edges": [{"source": "x", "target": "x"}]}, {"id": "a", "size": 2, "nodes": ["q"]}, {"id": "b"}]}
    files = spark.createDataFrame([("f", "scc_report_path", json.dumps(doc))], "folder string, kind string, text string")
    assert [tuple(r)[1:] for r in assemble.report_components(files).collect()] == [("a", 1, 2, True, ["x", "y"]), (None, 2, 0, False, ["q"]), ("b", 0, 0, False, [])]


def test_tree_and_bundle_agree(spark, sf, tmp_path):
    """The query's artifacts, written as files and read back."""
    runs = Q._conversations(spark, sf)
    for path, text in Q._files(runs).collect():
        at = tmp_path / path
        os.makedirs(at.parent, exist_ok=True)
        at.write_text(text, newline="")
    repos = runs.select("repo", F.lit("main").alias("base_branch"), F.lit("src").alias("entry"), F.when(F.col("r") % 2 == 0, "python").otherwise("csharp").alias("language")).distinct()
    plan = planning.planned_runs(config.analysis_plan(spark, Q.PLAN), runs.where("m = 0").select("repo", F.lit("main").alias("base_branch"), "cycle_id"), repos, str(tmp_path / Q.ROOT))
    got = assemble.assemble_runs(plan, assemble.read_results(spark, str(tmp_path / Q.ROOT)))
    key = ["mode_id", "experiment_id", "repo", "cycle_id"]
    rows = lambda df: sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*key, *assemble.OUTCOMES).collect())
    assert rows(got) == rows(Q.run_artifacts(spark, sf))


def test_command(spark, tree, tmp_path):
    from ringweave.__main__ import main

    root, _, _ = tree
    (tmp_path / "repos.txt").write_text("r main src python\n")
    (tmp_path / "cycles.txt").write_text("r main scc_0_cycle_0\n")
    pytest.importorskip("yaml")
    (tmp_path / "config.yaml").write_text(f"repos_file: {tmp_path}/repos.txt\ncycles_file: {tmp_path}/cycles.txt\nresults_root: '{root}'\n")
    (tmp_path / "plan.yaml").write_text("modes: [{id: none, label: N, experiments: [e]}, {id: adv, label: A, experiments: [e]}]\n")
    main(["tables", "--config", f"{tmp_path}/config.yaml", "--analysis-plan", f"{tmp_path}/plan.yaml", "--out", f"{tmp_path}/out"])
    assert {"all_runs", "main_results", "edit_footprint"} <= set(os.listdir(tmp_path / "out"))

import pytest
from pyspark.sql import functions as F

from ringweave.operators import evaluate as V
from ringweave.operators import planning, select, status
from ringweave.functions import exprs as E

SCC = "graph_id string, scc_id string, size long, edge_count long, self_loop boolean, nodes array<string>"


def structural(spark, post_edges, post_sccs, **flags):
    has = dict(has_graph=True, has_report=True, has_catalog=True, has_post_report=True, has_post_graph=True, no_change=False) | flags
    runs = spark.createDataFrame([("r", "b", "p", flags.get("cycle_id", "scc_0_cycle_0"))], "run_id string, graph_id string, post_graph string, cycle_id string")
    runs = runs.withColumns({k: F.lit(v) for k, v in has.items() if k != "cycle_id"})
    base = spark.createDataFrame([("b", "scc_0", 3, 5, False, ["a", "b", "c"])], SCC)
    edge = "array<struct<source:string,target:string>>"
    cat = spark.createDataFrame([("b", "scc_0_cycle_0", [("a", "b"), ("b", "c"), ("c", "a")])], f"graph_id string, cycle_id string, edges {edge}")
    e = spark.createDataFrame([("p", *x) for x in post_edges], "graph_id string, src string, dst string")
    s = spark.createDataFrame([("p", *x) for x in post_sccs], SCC)
    return V.structural_metrics(runs, base, cat, e, s).first().asDict()


RING = [("a", "b"), ("b", "c"), ("c", "a")]


def test_unchanged_graph(spark):
    got = structural(spark, RING + [("a", "c"), ("b", "a")], [("scc_0", 3, 5, False, ["a", "b", "c"])])
    assert got["structurally_evaluable"] and not got["cycle_eliminated_raw"]
    assert not got["weakening_improvement_raw"] and got["post_local_redundancy"] == 2


def test_weakened(spark):
    got = structural(spark, RING, [("scc_0", 3, 3, False, ["a", "b", "c"])])
    assert got["weakening_improvement_raw"] and not got["structural_improvement_raw"] and not got["cycle_eliminated_raw"]


def test_dissolved(spark):
    got = structural(spark, [("a", "b"), ("b", "c")], [])
    assert got["cycle_eliminated_raw"] and got["structural_improvement_raw"] and not got["global_structural_regression_raw"]


def test_self_loop_counts_as_a_component(spark):
    got = structural(spark, [("a", "b"), ("b", "c"), ("a", "a")], [("scc_0", 1, 1, True, ["a"])])
    assert got["weakening_improvement_raw"]  # one component, less redundancy


def test_new_cycle_elsewhere(spark):
    got = structural(spark, [("a", "b"), ("x", "y"), ("y", "x")], [("scc_0", 2, 2, False, ["x", "y"])])
    assert got["global_regression_outside_target_raw"] and got["global_structural_regression_raw"]


def test_missing_graph_after(spark):
    got = structural(spark, RING, [], has_post_graph=False)
    assert not got["structurally_evaluable"] and not got["cycle_eliminated_raw"] and got["baseline_global_redundancy"] == 0


def test_no_change_needs_no_graph_after(spark):
    got = structural(spark, RING, [], has_post_graph=False, has_post_report=False, no_change=True)
    assert got["structurally_evaluable"] and got["post_local_redundancy"] == got["baseline_local_redundancy"] == 2
    assert got["post_global_redundancy"] == 2


def test_odd_cycle_id_keeps_defaults(spark):
    got = structural(spark, [("a", "b")], [], cycle_id="odd")
    assert got["structurally_evaluable"] and not got["cycle_eliminated_raw"]


def test_outcomes(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0, 1, 0), (1, 1, 1, 0, 1, 1), (0, 1, 1, 0, 1, 0), (1, 0, 1, 1, 0, 0)],
        "behavior_preserved int, structurally_evaluable int, cycle_eliminated_raw int, structural_improvement_raw int, weakening_improvement_raw int, global_structural_regression_raw int")
    got = [(r["cycle_broken"], r["local_improvement"], r["success"], r["other_incomplete"]) for r in V.derive_outcomes(rows).collect()]
    assert got == [(1, 1, 1, 0), (1, 1, 0, 0), (0, 0, 0, 0), (1, 0, 0, 1)]


def test_counts_prefer_pytest_and_regressions_show(spark):
    block = "struct<tests:long,failures:long,errors:long,skipped:long>"
    m = spark.createDataFrame([("a", (10, 1, 0, 1), (5, 0, 0, 0)), ("b", None, (5, 0, 0, 0)), ("c", None, None)], f"run_id string, pytest {block}, dotnet_test {block}")
    got = {r["run_id"]: (r["tests"], r["passed"]) for r in V.test_counts(m).collect()}
    assert got == {"a": (10, 8), "b": (5, 5), "c": (None, None)}


def slow_selection(pool, bins, total, max_per_repo):
    """The choice one by one over a list."""
    want = select.bin_targets({b: sum(c["bin"] == b for c in pool) for _, _, b in bins}, E.bin_priority(bins), total)
    out = []
    for upto in (want, dict.fromkeys(want, total)):
        for b in want:
            while len(out) < total and sum(c["bin"] == b for c in out) < upto[b]:
                uses = lambda c, n: sum(n in o["nodes"] for o in out if o["repo"] == c["repo"])
                of_repo = lambda c: sum(o["repo"] == c["repo"] for o in out)
                free = [c for c in pool if c["bin"] == b and c not in out and of_repo(c) < max_per_repo and all(uses(c, n) < 2 for n in c["nodes"])]
                if not free:
                    break
                out.append(min(free, key=lambda c: (of_repo(c), sum(uses(c, n) > 0 for n in c["nodes"]), -c["size"], c["repo"], c["cycle_id"])))
    return out


def test_selection_caps_and_targets(spark):
    bins = E.parse_bins("2-3,6-4")
    assert bins == [(2, 3, "2-3"), (4, 6, "4-6")]
    pool = [dict(repo=r, cycle_id=f"c{i}", nodes=[f"{r}{i}", f"{r}{i + 1}"], size=s, bin=E.parse_bins("2-3,4-6")[s > 3][2]) for r in "xyz" for i, s in enumerate((2, 3, 4, 5))]
    cands = spark.createDataFrame(pool, "repo string, cycle_id string, nodes array<string>, size int, bin string")
    got = [r.asDict() for r in select.greedy_selection(cands, bins, 5, 2).orderBy("pick_no").collect()]
    assert [g["pick_no"] for g in got] == list(range(5))
    assert all(sum(g["repo"] == r for g in got) <= 2 for r in "xyz")
    assert got[0]["size"] == 5 and sum(g["bin"] == "4-6" for g in got) >= 3
    assert [{k: v for k, v in g.items() if k != "pick_no"} for g in got] == slow_selection(pool, bins, 5, 2)
    with pytest.raises(ValueError):
        select.bin_targets({}, ["2-3"], 3)


def test_plan_checks_references(spark):
    modes = spark.createDataFrame([("m", "M", 0, ["e1", "e2"])], "mode_id string, mode_label string, mode_order int, experiments array<string>")
    repos = spark.createDataFrame([("r", "main", "src", "python")], "repo string, base_branch string, entry string, language string")
    cyc = lambda b: spark.createDataFrame([("r", b, "scc_0_cycle_1")], "repo string, base_branch string, cycle_id string")
    row = planning.planned_runs(modes, cyc("main"), repos, "out").orderBy("experiment_id").first()
    assert row["branch_name"] == "atd-e1-m-scc_0_cycle_1" and row["post_graph_path"] == "out/r/branches/atd-e1-m-scc_0_cycle_1/ATD_identification/dependency_graph.json"
    with pytest.raises(Exception, match="unknown repository or branch"):
        planning.planned_runs(modes, cyc("dev"), repos, "out").collect()


def test_mode_params():
    assert planning.mode_params({"orchestrator": "MULTI_agent", "edge_variant": "e1"}) == {"orchestrator": "multi_agent", "edge_variant": "E1"}
    for bad in ({"edge_variant": "E9"}, {"colour": "red"}, {"orchestrator": "minimal", "edge_variant": "E1"}):
        with pytest.raises(ValueError):
            planning.mode_params(bad)


def test_resume_and_gates(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "u string")
    log = spark.createDataFrame([("a", "x", 1, "failed"), ("a", "x", 2, "ok"), ("b", "x", 1, "ok"), ("b", "x", 3, "failed")], "u string, phase string, ts int, outcome string")
    assert {r["u"] for r in status.to_run(units, log, ["u"], "x").collect()} == {"b", "c"}
    assert {r["u"] for r in status.to_run(units, log, ["u"], "x", units.where("u <> 'a'")).collect()} == {"a", "b", "c"}
    assert {r["u"] for r in status.gate(units, log, ["u"], "x").collect()} == {"a"}
    done = []
    rows = status.run_phase(["a", "b", "c"], "x", lambda u: ("blocked" if u == "b" else "ok", ""), done.append)
    assert [r["outcome"] for r in rows] == ["ok", "blocked"] and len(done) == 4
    ran = spark.createDataFrame([("a", "p", 0, "ok", ""), ("b", "p", 1, "blocked", "llm"), ("c", "p", 2, "ok", ""), ("a", "q", 0, "failed", "x")], "unit string, phase string, ord int, outcome string, reason string")
    assert sorted(tuple(r) for r in status.replay(ran).collect()) == [
        ("a", "p", 0, 0, "started", ""), ("a", "p", 0, 1, "ok", ""), ("a", "q", 0, 0, "started", ""), ("a", "q", 0, 1, "failed", "x"), ("b", "p", 1, 2, "started", ""), ("b", "p", 1, 3, "blocked", "llm"),
    ]
    assert status.replay(ran, stop_on_blocked=False).count() == 8
    with pytest.raises(Exception, match="no such outcome"):
        status.replay(ran.withColumn("outcome", F.lit("odd"))).collect()
    files = lambda *rows: status.digests(spark.createDataFrame(rows, "u string, role string, path string, text string"), ["u", "role"])
    then = files(("a", "input", "x", "1"), ("a", "output", "y", "2"), ("b", "input", "x", "1"), ("c", "input", "x", None), ("d", "input", "x", "1"))
    now = files(("a", "output", "y", "2"), ("a", "input", "x", "1"), ("b", "input", "x", "1"), ("b", "output", "z", "3"), ("c", "input", "x", None), ("d", "input", "x", "1 "))
    assert {r["u"] for r in status.unchanged(then, now, ["u"]).collect()} == {"a", "c"}
    names = spark.createDataFrame([("main", "e"), ("atd-e-x", "e"), ("atd-f-x", "e"), (None, "e")], "b string, x string")
    assert [r["d"] for r in names.select(status.deletable("b", F.lit("main"), "x").alias("d")).collect()] == [False, True, False, False]
    snap = lambda rows: spark.createDataFrame(rows, "u string, outcome string, mtime int")
    got = status.resume_violations(snap([("a", "ok", 1), ("b", "failed", 1), ("c", "ok", 1)]), snap([("a", "ok", 1), ("b", "ok", 1), ("c", "ok", 2)]), ["u"])
    assert {(r["u"], r["violation"]) for r in got.collect()} == {("b", "not run"), ("c", "touched")}
    want = status.expect_metrics(units, spark.createDataFrame([("a", "committed")], "u string, outcome string"), spark.createDataFrame([("a", "ok"), ("b", "ok")], "u string, outcome string"), ["u"])
    assert {r["u"] for r in want.collect()} == {"b", "c"}

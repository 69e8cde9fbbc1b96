import json

import pytest
from pyspark.sql import functions as F

from ringweave.operators import graph as G
from ringweave.operators import tables
from ringweave.sources import config, graphs, quality, runs, sinks, text
from ringweave.streaming import status_stream


def value(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_lists(spark, tmp_path):
    p = tmp_path / "repos.txt"
    p.write_text("# c\n\nr main src python\nq dev lib\n")
    assert [tuple(r)[:4] for r in text.read_repos(spark, str(p), strict=False).orderBy("ord").collect()] == [("r", "main", "src", "python"), ("q", "dev", "lib", "unknown")]
    with pytest.raises(Exception, match="needs 4 fields"):
        text.read_repos(spark, str(p)).collect()
    p.write_text("r main scc_0_cycle_1\nr main scc_0_cycle_1\nr main x y\n")
    assert text.read_cycles(spark, str(p)).count() == 3
    assert [r[0] for r in text.selected_cycles(spark, str(p), "r", "main").collect()] == ["scc_0_cycle_1"]


def test_documents_survive_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"edges": [{"source": "x", "target": "y"}, {"source": "x"}, {"source": "z", "target": "z"}], "nodes": [{"id": "w"}]}')
    (tmp_path / "b.json").write_text("[1, 2]")
    (tmp_path / "c.json").write_text("{broken")
    docs = text.read_json_documents(spark, str(tmp_path), graphs.GRAPH).withColumn("graph_id", F.element_at(F.split("path", "/"), -1))
    assert {(r["src"], r["dst"]) for r in graphs.edges_of(docs).collect()} == {("x", "y"), ("z", "z")}
    assert {r["node"] for r in graphs.nodes_of(docs).collect()} == {"w", "x", "y", "z"}


def test_tolerant_records(spark):
    raw = spark.createDataFrame([("g", '{"nodes": ["a", {"id": "b"}, {"x": 1}]}')], "graph_id string, text string")
    assert {r["node"] for r in graphs.tolerant_nodes(raw).collect()} == {"a", "b"}
    rec = spark.createDataFrame([('{"files": ["a"], "cycle_edges": [{"source": "a", "target": "b"}]}',)], "record string")
    n, e = graphs.tolerant_cycle()
    r = rec.select(n.alias("n"), e.alias("e")).first()
    assert r["n"] == ["a"] and r["e"][0]["target"] == "b"
    bad = spark.createDataFrame([("g", '{"imports": []}')], "graph_id string, text string")
    with pytest.raises(Exception, match="module listing"):
        graphs.modules_of(bad).collect()


def test_reports_and_catalogs(spark):
    report = '{"node_features": {"a": {"pagerank": 0.5}}, "sccs": [{"id": "scc_0", "size": 1, "edge_count": 1, "nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "a"}]}]}'
    d = spark.createDataFrame([("g", report)], "graph_id string, t string").withColumn("doc", F.from_json("t", graphs.SCC_REPORT))
    r = graphs.sccs_of(d).first()
    assert r["self_loop"] and r["nodes"] == ["a"] and graphs.ranks_of(d).first()["rank"] == 0.5
    cat = '{"sccs": [{"id": "scc_0", "cycles": [{"id": "scc_0_cycle_0", "length": 2, "nodes": ["a", "b"], "edges": [], "metrics": {"pagerank_avg": 0.1}}]}]}'
    d = spark.createDataFrame([("g", cat)], "graph_id string, t string").withColumn("doc", F.from_json("t", graphs.CATALOG))
    assert graphs.cycles_of(d).first()["cycle_id"] == "scc_0_cycle_0"


def test_junit_and_trial(spark):
    xml = '<testsuites><testsuite tests="3" failures="1" errors="0" skipped="1"><testsuite tests="2"/></testsuite></testsuites>'
    assert tuple(value(spark, quality.junit_counts(F.lit(xml)))) == (5, 1, 0, 1)
    assert tuple(value(spark, quality.junit_counts(F.lit(None).cast("string")))) == (0, 0, 0, 0)
    log = "Ran 7 tests in 1s\nPASSED (successes=1)\nFAILED (failures=2, errors=1, skips=3)\n"
    assert tuple(value(spark, quality.trial_counts(F.lit(log)))) == (7, 2, 1, 3)
    assert tuple(value(spark, quality.trial_counts(F.lit("PASSED (skips=4, successes=10, expectedFailures=1)")))) == (15, 0, 0, 4)
    assert tuple(value(spark, quality.test_counts(F.lit(None).cast("string"), F.lit(log)))) == (7, 2, 1, 3)


def test_other_reports(spark):
    assert value(spark, quality.coverage_percent(F.lit('<?xml version="1.0" ?><coverage line-rate="0.81254"/>'))) == 81.25
    assert value(spark, quality.lint_issues(F.lit('[{"a": 1}, {}]'))) == 2 and value(spark, quality.lint_issues(F.lit("x\n\ny\n"))) == 2
    assert tuple(value(spark, quality.maintainability(F.lit('{"a": {"mi": 50.126}, "b": {"mi": 10}, "c": {}}')))) == (30.06, 10.0, 2)
    d = value(spark, quality.dead_code(F.lit("a.py:1: unused x (60% confidence)\nnoise\nb.py:22: y (75% confidence)\n")))
    assert d["suspects"] == 2 and d["by_confidence"] == {"60": 1, "90": 0, "100": 0, "75": 1}
    trx = '<TestRun xmlns="http://x/y"><ResultSummary><Counters total="10" executed="7" failed="2" error="1" timeout="1" aborted="0"/></ResultSummary></TestRun>'
    assert tuple(value(spark, quality.trx_counts(F.lit(trx)))) == (10, 2, 2, 3)
    cc = spark.createDataFrame([("r", '{"f.py": [{"rank": "A"}, {"complexity": {"rank": "B"}}, {"complexity": 3}], "g.py": {"functions": [{"rank": "A"}]}}')], "k string, t string")
    r = quality.complexity_counts(cc, "k", "t").first()
    assert r["total"] == 4 and r["by_rank"] == {"A": 2, "B": 1, "?": 1}
    sarif = json.dumps({"runs": [{"results": [{"level": "Warning"}, {"level": "error", "suppressionStates": ["x"]}, {}, {"level": "note"}]}, {}]})
    assert quality.sarif_issues(spark.createDataFrame([("r", sarif)], "k string, t string"), "k", "t").first()["issues"] == 1


def test_lizard(spark):
    rows = [("r", "CCN", "", None), ("r", "5", "f@1@./a.cs", ""), ("r", "41", "", '"./b.cs"'), ("r", "21", "", "./b.cs")]
    r = quality.lizard_metrics(spark.createDataFrame(rows, "k string, _c0 string, _c5 string, _c6 string"), "k").first()
    assert (r["cc_total"], r["cc_p95"], r["cc_over_20"], r["cc_over_40"], r["functions"], r["files"]) == (67, 41, 2, 1, 3, 2)


def test_trajectories_and_outcomes(spark):
    t = json.dumps([{"action": "run", "tool_call_metadata": {"model_response": {"id": "1"}}}, 5, {"action": "finish", "llm_metrics": {"accumulated_token_usage": {"prompt_tokens": 3, "completion_tokens": 4}}}])
    r = spark.createDataFrame([("a", t), ("b", "{}"), ("c", None)], "run_id string, trajectory string")
    s = {x["run_id"]: (x["responses"], x["finished"]) for x in tables.trajectory_summary(runs.trajectory_events(r, ["run_id"]), ["run_id"]).collect()}
    assert s == {"a": (1, True)}
    assert value(spark, runs.outcome_of(F.lit('{"outcome": " ok "}'))) == "ok" and value(spark, runs.outcome_of(F.lit("bad"))) == ""


def test_listings(spark):
    f = spark.createDataFrame([("r", p) for p in ("docs/README.md", "readme.md", "a/b/c/d/e/f/g/readme.md", "src/x.sln", "y.csproj", "z.sln")], "repo string, path string")
    assert [r["path"] for r in text.find_readmes(f).orderBy("place").collect()] == ["readme.md", "docs/README.md"]
    assert text.pick_project(f).first()["path"] == "z.sln"
    k = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = text.scan_files(k("a", "b", "c", "d"), k("b", "e"), k("b", "c"), k("d"), ["path"])
    assert {r["path"] for r in got.collect()} == {"a", "b", "e"}


def test_config(spark):
    base = dict.fromkeys(config.REQUIRED, "x") | {
        "policy": {"delete_refactor_branches_after_metrics": False},
        "llm": {"base_url": "u", "api_key": "k", "model_raw": "m", "context_length": 9},
        "openhands": {"runtime_image": "i", "max_iters": 150, "commit_message": "c"},
        "modes": [{"id": "m", "params": {"orchestrator": "minimal"}}],
    }
    c = config.PipelineConfig.of(base)
    assert c.modes == (("m", (("orchestrator", "minimal"),)),) and c.delete_branches is False
    assert c.llm.context_length == 9 and c.agent.max_iters == 150
    for name, value in (
        ("modes", []), ("modes", [{"id": "m"}, {"id": "m"}]), ("modes", None), ("projects_dir", " "), ("policy", None), ("policy", {}), ("policy", {"delete_refactor_branches_after_metrics": 1}),
        ("llm", None), ("llm", {**base["llm"], "context_length": "9"}), ("llm", {**base["llm"], "context_length": True}), ("llm", {**base["llm"], "api_key": ""}), ("openhands", {"max_iters": 1}),
    ):
        with pytest.raises(ValueError):
            config.PipelineConfig.of(base | {name: value})
    plan = config.analysis_plan(spark, {"modes": [{"id": "b", "label": "B", "experiments": ["1"]}, {"id": "a", "label": "A", "experiments": ["1", "2"]}]})
    assert [r["mode_id"] for r in plan.orderBy("mode_order").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        config.analysis_plan(spark, {"modes": [{"id": "b", "label": "B", "experiments": ["1", "1"]}]})


def test_sinks_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("m", 3, 50.0, None)], "mode_id string, runs long, success_pct double, behavior_pct double")
    sinks.write_csv(t, str(tmp_path / "t"), titles=True)
    back = text.read_csv(spark, str(tmp_path / "t"))
    assert back.columns == ["mode_id", "Runs", "Success", "Behavior preserved"] and back.first()["Behavior preserved"] is None
    sinks.append_jsonl(t, str(tmp_path / "j"))
    sinks.append_jsonl(t, str(tmp_path / "j"))
    assert text.read_jsonl(spark, str(tmp_path / "j")).count() == 2
    s = spark.createDataFrame([(1, "r", "main", "c1"), (0, "q", "main", "c0")], "pick_no int, repo string, base_branch string, cycle_id string")
    sinks.write_selection(s, str(tmp_path / "s"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["q main c0", "r main c1"]
    e = spark.createDataFrame([("g", "b", "a")], "graph_id string, src string, dst string")
    n = spark.createDataFrame([("g", "b"), ("g", "a")], "graph_id string, node string")
    doc = json.loads(sinks.graph_documents(n, e).first()["doc"])
    assert [x["id"] for x in doc["nodes"]] == ["a", "b"] and doc["edges"][0]["target"] == "a"
    assert set(doc) == {"schema_version", "language", "repo_root", "entry", "nodes", "edges"} and set(doc["nodes"][0]) == {"id", "kind", "abs_path"}


def test_documents_read_back(spark):
    """What the sinks write, the sources read."""
    e = spark.createDataFrame([("g", a, b) for a, b in ("ab", "ba", "bc", "cb", "de", "ed", "fa")], "graph_id string, src string, dst string")
    n = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).withColumn("abs_path", F.concat(F.lit("/r/"), "node")).union(spark.createDataFrame([("h", "z", "/r/z")], "graph_id string, node string, abs_path string"))
    info = spark.createDataFrame([("g", "python", "/r", "src", "main")], "graph_id string, language string, repo_root string, entry string, repo string")
    docs = {r["graph_id"]: json.loads(r["doc"]) for r in sinks.graph_documents(n, e, info).collect()}
    assert docs["g"]["language"] == "python" and docs["g"]["nodes"][0] == {"id": "a", "kind": "file", "abs_path": "/r/a"} and docs["h"]["edges"] == []
    m = G.strong_components(e)
    loc = n.distinct().select("graph_id", "node", F.lit(10).alias("loc"))
    sccs = G.scc_metrics(e, m, loc)
    size = n.groupBy("graph_id").agg(F.countDistinct("node").alias("node_count")).withColumn("edge_count", F.when(F.col("graph_id") == "g", 7).otherwise(0))
    ranks = n.select("graph_id", "node").distinct().withColumn("rank", F.lit(0.125))
    made = sinks.report_documents(sccs, G.induced_edges(e, m), G.scc_global(sccs), ranks, size, info, at=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    docs = {r["graph_id"]: json.loads(r["doc"]) for r in made.collect()}
    g = docs["g"]
    assert set(g) == {"schema_version", "generated_at_utc", "input", "graph", "params", "global_metrics", "node_features", "sccs"}
    assert g["generated_at_utc"] == "2024-01-02T03:04:05Z" and g["input"]["entry"] == "src" and g["graph"] == {"node_count": 6, "edge_count": 7}
    assert g["global_metrics"] == {"scc_count": 2, "total_nodes_in_cyclic_sccs": 5, "total_edges_in_cyclic_sccs": 6, "total_loc_in_cyclic_sccs": 50, "max_scc_size": 3, "avg_scc_size": 2.5, "cycle_pressure_lb": 0}
    assert [s["size"] for s in g["sccs"]] == [3, 2] and g["sccs"][0]["avg_loc_per_node"] == 10.0 and g["sccs"][1]["edges"] == [{"source": a, "target": b, "relation": "import"} for a, b in ("de", "ed")]
    assert docs["h"]["sccs"] == [] and docs["h"]["global_metrics"]["scc_count"] == 0
    back = made.withColumn("doc", F.from_json("doc", graphs.SCC_REPORT))
    assert {(r["scc_id"], r["size"], r["edge_count"]) for r in graphs.sccs_of(back).collect()} == {("scc_0", 3, 4), ("scc_1", 2, 2)} and graphs.ranks_of(back).count() == 7
    cycles = G.cycle_catalog(G.pack_edge_disjoint(G.cycle_ranks(G.enumerate_cycles(e, m, 8), ranks), 1), G.rank_components(m))
    made = sinks.catalog_documents(cycles, sccs, info)
    doc = json.loads(made.first()["doc"])
    assert set(doc) == {"schema_version", "generated_at_utc", "input", "params", "summary", "sccs"} and doc["summary"] == {"scc_count": 2, "cycle_count": 2}
    assert doc["input"]["repo"] == "main" and doc["params"]["seed"] == 12345 and doc["sccs"][0]["node_count"] == 3
    back = made.withColumn("doc", F.from_json("doc", graphs.CATALOG))
    assert {r["cycle_id"] for r in graphs.cycles_of(back).collect()} == {"scc_0_cycle_0", "scc_1_cycle_0"}


def test_run_outcome_file(spark):
    facts = spark.range(1).select(*[F.lit(1).alias(c) for c in reversed(sinks.RUN_OUTCOMES)], F.lit(2).alias("more"))
    assert sinks.run_outcomes(facts).columns == [
        "repo", "experiment", "cycle", "mode", "configuration", "behavior", "cycle broken", "local improvement", "success", "global regression", "outside-target regression", "structural eval", "incomplete",
        "no change", "openhands outcome"]
    with pytest.raises(ValueError, match="no_change"):
        sinks.run_outcomes(facts.drop("no_change"))


def test_status_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, o in enumerate(("started", "ok", "ok", "blocked")):
        (src / f"{i}.json").write_text(json.dumps({"ts_utc": f"2024-01-01T00:0{i}:00Z", "run_id": "r", "phase": "x", "outcome": o}))
    s = status_stream.read_statuses(spark, str(src))
    q = status_stream.distinct_statuses(s).writeStream.format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["outcome"] for r in spark.table("statuses").collect()) == ["blocked", "ok", "started"]
    w = status_stream.outcome_counts(s, late="0 seconds").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("counts").collect()) == 4


def test_command_line(spark, tmp_path):
    from ringweave.__main__ import main

    (tmp_path / "in").mkdir()
    edges = [{"source": a, "target": b} for a, b in (("a", "b"), ("b", "a"), ("b", "c"))]
    (tmp_path / "in" / "g.json").write_text(json.dumps({"nodes": [], "edges": edges}))
    main(["cycles", "--graphs", str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    doc = json.loads(spark.read.json(str(tmp_path / "out" / "cycle_catalog")).first()["doc"])
    assert doc["sccs"][0]["cycles"][0]["id"] == "scc_0_cycle_0"
    report = json.loads(spark.read.json(str(tmp_path / "out" / "scc_report")).first()["doc"])
    assert report["global_metrics"]["scc_count"] == 1


def test_shared_folder(spark):
    from ringweave import session

    assert session.qualified(spark, "/tmp/x") == "file:///tmp/x" == session.qualified(spark, "file:/tmp/x") and session.qualified(spark, "s3://b/x") == "s3://b/x"
    assert session.work_dir(spark).startswith("file:///")
    df = session.stored(spark.range(3), "test")
    assert df.count() == 3 and df.columns == ["id"]
    assert [session._bytes(x) for x in ("64m", "1g", "7", "67108864b")] == [64 << 20, 1 << 30, 7, 64 << 20]


def test_what_is_stored_can_be_deleted(spark):
    import os

    from ringweave import session

    df = session.stored(spark.range(3).toDF("x"), "some")
    at = df._stored_at.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(at)
    session.drop_stored(df)
    assert not os.path.exists(at)
    session.drop_stored(spark.range(1))  # was never stored

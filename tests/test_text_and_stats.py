import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringweave.functions import exprs as E
from ringweave.operators import context, csharp, diff, pyast, stats
from ringweave.operators import tables as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_scalars(spark):
    r = one(spark, E.branch_name(F.lit(" a b//c--d#e- ")), E.short_label(F.lit("x/y/__init__.py")), E.short_label(F.lit("x/y.tar.gz")), E.module_name(F.lit("pkg/sub/__init__.py")),
        E.github_repo(F.lit("git@github.com:o/r.git")), E.github_repo(F.lit("https://github.com/o/r")), E.github_repo(F.lit("https://x.org/o/r")),
        E.scc_of_cycle(F.lit("scc_3_cycle_7")), E.scc_of_cycle(F.lit("x_cycle_7")), E.cycle_scc_lenient(F.lit("x_cycle_7")), E.parse_pct(F.lit("12.5%")), E.cycle_chain(F.array(F.lit("a"), F.lit("b"))))
    assert tuple(r) == ("a-b//c-d-e", "__init__", "y.tar", "pkg.sub", "o/r", "o/r", None, "scc_3", None, "x", 12.5, "a -> b -> a")


def test_rounding_is_half_even(spark):
    assert tuple(one(spark, E.pct(F.lit(1), F.lit(16)), E.pct(F.lit(3), F.lit(16)), E.pct(F.lit(1), F.lit(0)))) == (6.2, 18.8, None)


def test_imports_resolve(spark):
    r = lambda m, lv, t, p, c=False: one(spark, E.resolve_import(F.lit(m), F.lit(lv), F.lit(t).cast("string"), F.lit(p), c))[0]
    assert r("a.b", 1, "c", False) == "a.c" == pyast.resolve("a.b", False, 1, "c")
    assert r("a.b", 1, "c", True) == "a.b.c" == pyast.resolve("a.b", True, 1, "c")
    assert r("a.b", 0, "x.y", False) == "x.y" == pyast.resolve("a.b", False, 0, "x.y")
    assert r("a.b", 0, "x", False, True) == "a.b.x" == pyast.resolve("a.b", False, 0, "x", True)
    assert r("a", 3, "x", False) is None and pyast.resolve("a", False, 3, "x") is None


def test_buckets(spark):
    b = lambda p, d: one(spark, E.folder_bucket(F.lit(p), F.lit("src"), d))[0]
    assert [b("src/a/b/f.py", 1), b("src/a/b/f.py", 5), b("src/f.py", 2), b("lib/x/f.py", 1)] == ["a", "a/b", "", "lib"]


def test_blocks_and_explanations(spark):
    full = "--- BEGIN p ---\nbody\n--- END p ---\n"
    f = lambda n, t="body": one(spark, E.format_block(F.lit("p"), F.lit(t), F.lit(n)))[0]
    assert f(len(full)) == full and f(len(full) - 5) == "" and f(0) == ""
    assert f(60, "x" * 100) == "--- BEGIN p ---\n" + "x" * 16 + "\n[Truncated]\n" + "\n--- END p ---\n"
    text = "a " + E.EXPLANATION_ANCHOR + " b " + E.EXPLANATION_ANCHOR + " \n why"
    assert tuple(one(spark, E.explanation_length(F.lit(text)), E.explanation_length(F.lit("none")), E.explanation_length(F.lit(E.EXPLANATION_ANCHOR)))) == (3, None, 0)


def test_water_fill():
    assert context.water_fill([10, 1, 5], 9) == [4, 1, 4]
    assert context.water_fill([1, 1], 10) == [1, 1] and context.water_fill([], 3) == [] and context.water_fill([3, 3], 0) == [0, 0]
    rng = np.random.default_rng(0)
    for _ in range(200):
        needs, total = rng.integers(0, 30, rng.integers(1, 8)).tolist(), int(rng.integers(0, 60))
        got = context.water_fill(needs, total)
        assert sum(got) == min(total, sum(needs)) and all(g <= n for g, n in zip(got, needs))


def test_two_way_budget(spark):
    rows = spark.createDataFrame([(10, 10, 10), (2, 30, 20), (30, 2, 20), (5, 5, 100), (7, 9, 0)], "a int, b int, t int")
    got = [tuple(r["s"]) for r in rows.select(E.two_way_budget("a", "b", "t").alias("s")).collect()]
    assert got == [(5, 5), (2, 18), (18, 2), (5, 5), (0, 0)]


PATCH = """diff --git a/old.py b/new.py
rename from old.py
rename to new.py
--- a/old.py
+++ b/new.py
@@ -1,3 +1,3 @@
 a
-b
+B!
 c
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_footprint_and_patches(spark):
    p = spark.createDataFrame([("r", PATCH), ("none", None), ("empty", "")], "run_id string, patch string")
    got = {r["run_id"]: (r["files_modified"], r["chars_changed"]) for r in diff.diff_footprint(p).collect()}
    assert got == {"r": (3, 4), "none": (None, None), "empty": (0, 0)}
    a, b = diff.parse_patch(PATCH)
    assert (a.old, a.new, b.new) == ("old.py", "new.py", None)
    assert diff.apply_patch("a\nb\nc\n", a) == "a\nB!\nc\n" and diff.apply_patch("a\nX\nc\n", a) is None and diff.apply_patch("x\n", b) is None
    one = diff.parse_patch("diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y\n")[0]
    assert diff.apply_patch("x", one) == "y" and diff.apply_patch("x\n", one) == "y\n"
    lines = diff.patch_lines(p).orderBy("line_no").collect()
    assert [(r["file_ord"], r["kind"], r["text"]) for r in lines][:4] == [(1, "other", "a"), (1, "del", "b"), (1, "add", "B!"), (1, "other", "c")]


def test_signs_alone_tell_lines_of_a_hunk(spark):
    git = "diff --git a/f b/f\nindex 1..2\n--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n--- x\n+++ y\n---z\n+++\n c\ndiff --git a/g b/g\n--- a/g\n+++ b/g\n@@ -1 +1 @@\n-d\n"
    plain = "--- f\n+++ f\n@@ -1 +1 @@\n-a\n--- g\n+++ g\n@@ -1 +1 @@\n+b\n"
    p = spark.createDataFrame([("git", git), ("plain", plain)], "run_id string, patch string")
    got = [(r["run_id"], r["file_ord"], r["hunk_ord"], r["kind"], r["text"]) for r in diff.patch_lines(p).orderBy("run_id", "line_no").collect()]
    own = [("del", "-- x"), ("add", "++ y"), ("del", "--z"), ("add", "++"), ("other", "c")]
    assert got == [("git", 1, 1, *x) for x in own] + [("git", 2, 2, "del", "d"), ("plain", 0, 1, "del", "a"), ("plain", 0, 2, "add", "b")]
    assert [x[1:] for h in diff.parse_patch(git)[0].hunks for x in h.lines] == [t for _, t in own]


def test_one_line_end_ends_a_text(spark):
    texts = ["a", "a\n", "a\n\n", "a\r\n\r\n", "\n\n", "a\n\u2028", "", "a\r\nb\rc\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", E.lines_of("t").alias("l")).orderBy("n").collect()
    assert [r["l"] for r in got] == [["a"], ["a"], ["a", ""], ["a", ""], ["", ""], ["a", "\u2028"], [], ["a", "b", "c"]]


def test_patches_of_odd_texts_match_sql(spark, tmp_path):
    from sqlcheck import oracle, same

    from ringweave.plans import registry

    texts = ["", "\n", "a\n\n", "\n\n\n", "--x\n++y\n--- z\n+++ z\n---\n+++", "a\rb\n\r-c\r+d\r\ne", "a\n\u2028", " ", "@@ -1 +1 @@\ndiff --git a/x b/x\n@@", None]
    rows = [(i, t, "web", "en") for i, t in enumerate(texts)] + [(50, "a\nb", None, "en"), (51, "a\nb", "web", None), (52, "a", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "d"))
    spark.read.parquet(str(tmp_path / "d")).toPandas().to_parquet(tmp_path / "documents.parquet")
    same(registry.QUERIES["patch_lines"](spark, str(tmp_path)).toPandas(), oracle(registry.SQL["patch_lines"], tmp_path))


def test_python_facts():
    text = "from typing import TYPE_CHECKING\nimport os.path as p\nif TYPE_CHECKING:\n    import t\nelse:\n    import u\nfrom . import q\n"
    assert pyast.runtime_imports(text, "pkg.m") == ["os.path", "pkg", "typing"]
    assert pyast.runtime_imports("def (", "m") == []
    assert pyast.top_level_symbols(["def f():", "    def g():", "class C:", "async def h():"]) == ["f", "C", "h"]
    assert pyast.import_names(["import a.b", "from x import (y,", "def f():"]) == []
    assert pyast.import_names(["import a.b", "from .x import y as z"]) == [("a.b", "a"), (".x", "z")]
    f = pyast.analyse("def f(a: Ann = d):\n    return a + g\n")
    assert {n for n, _ in f.loads} == {"a", "g", "d"} and f.bound == {"f", "a"}
    assert pyast.analyse("g = lambda *json, **kw: json").bound == {"g", "json", "kw"}
    assert pyast.analyse("[x for y in z]\nwith a as (b, c):\n    d.e: int = f\n").bound == {"b", "c"}
    assert {n for n, _ in pyast.analyse("d.e: int = f\nclass K(B, metaclass=M):\n    pass\n").loads} == {"f", "B", "M"}
    assert pyast.removed_imports(["from .x import y as z, w", "import a.b", "    import c", "from m import *"]) == [("z", "x"), ("w", "x"), ("a", "a.b")]
    assert pyast.removed_imports(["from x import (y,"]) == []
    assert pyast.exported_names("import a.b\nx, y = 1, 2\ndef f(): pass\nz: int = 3") == ["a", "x", "y", "f", "z"]


def test_module_graph(spark):
    rows = [("g", "a", "a.py", ["b", "c"]), ("g", "b", "b.py", ["a"]), ("g", "c", "vendor/c.py", []), ("g", "d", "d.py", ["a"])]
    m = spark.createDataFrame(rows, "graph_id string, module string, path string, imports array<string>")
    seen = spark.createDataFrame([("g", "a.py", "b.x"), ("g", "b.py", "other")], "graph_id string, path string, imported string")
    assert {(r["src"], r["dst"]) for r in pyast.module_graph(m, seen).collect()} == {("a.py", "b.py"), ("d.py", "a.py")}


def test_bootstrap_is_deterministic():
    v = np.array([1.0, 2.0, 3.0, 10.0])
    a = stats.bootstrap_ci(v, 7, 500)
    assert a == stats.bootstrap_ci(v, 7, 500) and a[0] < v.mean() < a[1]
    assert stats.bootstrap_ci(np.array([]), 1) == (None, None)
    assert stats.seed_of("ab") == 12345 + 97 + 98


def test_glmm_recovers_simulated_effects():
    rng = np.random.default_rng(1)
    groups, n = np.repeat(np.arange(300), 2), 20
    x = np.tile([0.0, 1.0], 300)
    eta = -0.5 + 0.8 * x + rng.normal(0, 1.2, 300)[groups]
    won = rng.binomial(n, 1 / (1 + np.exp(-eta)))
    m = stats.Glmm(groups, won, np.full(600, n), x).fit()
    assert m.p[1] == pytest.approx(0.8, abs=0.1) and math.sqrt(m.variance) == pytest.approx(1.2, abs=0.15)
    null = stats.Glmm(groups, won, np.full(600, n), np.zeros((600, 0))).fit()
    assert stats.lrt_p(m.ll, null.ll) < 0.001


def slow_laplace(m, p):
    """The Laplace approximation group by group, by the mode on a fine line and a second difference."""
    s, total = math.exp(p[-1]), m.base
    for k in range(len(m.names)):
        i = m.g == k
        f = lambda u: (m.won[i] * (m.x[i] @ p[:-1] + s * u) - m.trials[i] * np.logaddexp(0, m.x[i] @ p[:-1] + s * u)).sum() - u * u / 2  # noqa: B023, E731
        lo, hi = -9.0, 9.0
        for _ in range(200):  # the function is concave
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if f(a) < f(b) else (lo, b)
        u, h = (lo + hi) / 2, 1e-4
        total += f(u) - 0.5 * math.log(-(f(u + h) - 2 * f(u) + f(u - h)) / h**2)
    return total


def test_laplace_against_a_plain_one():
    rng = np.random.default_rng(4)
    g, x = np.repeat(np.arange(8), 2), np.tile([0.0, 1.0], 8)
    trials = rng.integers(1, 16, 16)
    m = stats.Glmm(g, rng.binomial(trials, 0.4), trials, x)
    for p in ([-0.4, 0.5, 0.3], [0.2, -1.0, 1.0], [0.0, 0.0, -2.0]):
        assert m.loglik(np.array(p)) == pytest.approx(slow_laplace(m, np.array(p)), abs=1e-4)
    # an outer intercept that hardly varies leaves the model as it is
    wide = stats.Glmm(g, m.won, trials, x, outer=g // 4)
    assert wide.loglik(np.array([-0.4, 0.5, 0.3, -12.0])) == pytest.approx(m.loglik(np.array([-0.4, 0.5, 0.3])), abs=1e-6)
    # groups that are alike may be given once, with their number
    twice = stats.Glmm(np.concatenate([g, g + 8]), np.tile(m.won, 2), np.tile(trials, 2), np.tile(x, 2))
    once = stats.Glmm(g, m.won, trials, x, weight=np.full(16, 2))
    assert twice.loglik(np.array([-0.4, 0.5, 0.3])) == pytest.approx(once.loglik(np.array([-0.4, 0.5, 0.3])), abs=1e-6)


def test_laplace_of_nested_groups_is_near_quadrature():
    rng = np.random.default_rng(5)
    cycle, repo = np.repeat(np.arange(40), 2), np.repeat(np.arange(8), 10)
    trials, x = np.full(80, 40), np.tile([0.0, 1.0], 40)
    won = rng.binomial(trials, 1 / (1 + np.exp(-(0.3 * x + rng.normal(0, 0.5, 40)[cycle] + rng.normal(0, 0.5, 8)[repo]))))
    p = np.array([0.1, 0.3, math.log(0.5), math.log(0.5)])
    a, b = stats.Glmm(cycle, won, trials, x, repo), stats.Glmm(cycle, won, trials, x, repo, points=25)
    assert a.loglik(p) == pytest.approx(b.loglik(p), abs=0.3)


def test_bootstrap_draws_are_one_stream():
    v = np.random.default_rng(0).normal(size=37)
    rng = np.random.default_rng(9)
    means = np.array([rng.choice(v, size=len(v), replace=True).mean() for _ in range(300)])
    assert stats.bootstrap_ci(v, 9, 300) == (float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975)))


def test_glmm_without_group_effect_is_logistic():
    won, trials, x = np.array([30, 45] * 20), np.full(40, 60), np.array([0.0, 1.0] * 20)
    m = stats.Glmm(np.repeat(np.arange(20), 2), won, trials, x).fit()
    assert m.p[0] == pytest.approx(0, abs=0.02) and m.p[1] == pytest.approx(math.log(3), abs=0.02)


def test_placeholders(spark):
    f = spark.createDataFrame([("r", "c", "m", 0)], "repo string, cycle_id string, mode_id string, success int")
    assert stats.configuration_model(f, "m", "other")["coefficient"].isna().all()
    assert stats.comparisons_of({"no_explain", "explain_E1_S1_noaux"}) == [("Advisory vs No-explanation", "explain_E1_S1_noaux", "no_explain")]


def test_empty_cells_stay(spark):
    cols = "mode_id string, mode_label string, language string, behavior_preserved int, cycle_broken int, local_improvement int, success int"
    f = spark.createDataFrame([("a", "A", "python", 1, 1, 1, 1), ("b", "B", "csharp", 0, 0, 0, 0)], cols)
    got = {(r["mode_id"], r["language"]): (r["runs"], r["success_pct"]) for r in T.language_breakdown(f).collect()}
    assert got == {("a", "python"): (1, 100.0), ("a", "csharp"): (0, None), ("b", "python"): (0, None), ("b", "csharp"): (1, 0.0)}
    with pytest.raises(ValueError, match="missing columns"):
        T.main_results(f.drop("success"))


def test_scc_summary(spark):
    c = spark.createDataFrame([("g", "c", ["a", "b"])], "graph_id string, cycle_id string, nodes array<string>")
    e = spark.createDataFrame([("g", "c", *x) for x in (("a", "b"), ("b", "a"), ("a", "x"), ("b", "x"), ("a", "y"), ("y", "b"))], "graph_id string, cycle_id string, src string, dst string")
    text = context.scc_summary(c, e, 2).first()["summary"]
    assert text.startswith("SCC summary: 4 nodes, 6 edges\nCycle summary: 2 nodes, 2 edges (as given)\n\n")
    assert "- a (in=1, out=3, total=4)\n- b (in=2, out=2, total=4)" in text and "- x (2)\n- y (1)" in text
    assert "- a -> x\n- a -> y\n- ... +1 more" in text and "- (none visible)" in text


def test_external_connections(spark):
    c = spark.createDataFrame([("g", "c", ["src/a.py"], "src")], "graph_id string, cycle_id string, nodes array<string>, src_root string")
    e = spark.createDataFrame([("g", "src/a.py", f"src/{p}") for p in ("k/1.py", "k/2.py", "m/3.py")], "graph_id string, src string, dst string")
    r = context.external_connections(c, e, 1, 1, 2).first()
    assert (r["total"], r["folders"], r["omitted_folders"], r["samples"], r["omitted"]) == (3, "src/k (2)", 1, ["src/k/1.py", "src/m/3.py"], 1)


def test_glmm_with_two_intercepts():
    rng = np.random.default_rng(2)
    repo = np.repeat(np.arange(60), 10)
    cycle = np.repeat(np.arange(300), 2)
    x = np.tile([0.0, 1.0], 300)
    eta = 0.6 * x + rng.normal(0, 0.9, 60)[repo] + rng.normal(0, 0.7, 300)[cycle]
    won = rng.binomial(30, 1 / (1 + np.exp(-eta)))
    m = stats.Glmm(cycle, won, np.full(600, 30), x, repo).fit()
    assert m.p[1] == pytest.approx(0.6, abs=0.12)
    assert math.sqrt(m.variance) == pytest.approx(0.7, abs=0.15) and math.sqrt(m.outer_variance) == pytest.approx(0.9, abs=0.25)


def test_displays(spark):
    r = one(spark, E.fallback_label(F.lit("explain_E1_S1_noaux")), E.display_configuration(F.lit("x"), F.lit("X"), ["x", "no_explain"]), E.display_configuration(F.lit("x"), F.lit("X"), ["x", "y", "no_explain"]),
        E.fill_template("a {r} b {c}", {"r": F.lit("1"), "c": F.lit("2")}), E.utc_text(F.lit("2024-01-31 12:00:00").cast("timestamp")))
    assert tuple(r) == ("E1 S1", "selected", "X", "a 1 b 2", "2024-01-31T12:00:00Z")
    f = spark.createDataFrame([("no_explain", 0), ("x", 1)], "mode_id string, mode_order int")
    assert T.selected_mode(f) == "x" and T.selected_mode(f.where("mode_order = 1")) is None
    assert [r["mode_id"] for r in T.in_display_order(f.select("mode_id"), f).collect()] == ["no_explain", "x"]


def test_prompts(spark):
    rows = spark.createDataFrame([("c", 1, "b -> c", "second " * 50, 40), ("c", 0, "a -> b", "first", 40)], "cycle_id string, ord int, edge string, report string, budget int")
    text = context.synthesizer_prompt(rows, ["cycle_id"], F.lit("system"), F.lit("extra"), "budget").first()["prompt"]
    assert text.startswith("system\n\nextra\n\n--- BEGIN a -> b ---\nfirst\n") and "[Truncated]" in text
    e = spark.createDataFrame([("a.py", "b.py", "x", "y", 100)], "src string, dst string, src_text string, dst_text string, budget int")
    assert "Edge: a.py -> b.py" in context.edge_prompt(e, F.lit("s"), "budget").first()["prompt"]
    assert one(spark, context.minimal_prompt(F.array(F.lit("a"), F.lit("b")), F.lit("python")))[0].endswith(E.EXPLANATION_ANCHOR)
    units = spark.createDataFrame([("u", "E1", None), ("v", "E0", "S2")], "u string, e string, s string")
    assert sorted(tuple(r) for r in context.require_variants(units, ["e", "s"]).collect()) == [("u", "E1", "edge", "advisory"), ("v", "E0", "edge", "descriptive"), ("v", "S2", "synthesizer", "directive")]
    with pytest.raises(Exception, match="no such prompt variant"):
        context.require_variants(units.withColumn("e", F.lit("E7")), ["e"]).collect()


def test_csharp_scan():
    text = """// class Not { }
using System.Collections.Generic;
using static A.Tools;
using M = A.B.Model;
namespace X.Y;
#region class Neither
[Serializable]
public partial class User<T> : Base, IThing where T : Other
{
    public record struct Point(int A, Shape B);
    delegate Result<int> Handler(Arg a);
    private M model = new("class Text {}");
    var q = A.C.Deep.Create(@"new ""Quoted"" ", 'c', $"{Hidden}");
    object o = list.Member;
}
enum Kind { One }
"""
    declared, mentioned = csharp.scan(text)
    assert declared == {("X.Y", "User"), ("X.Y", "Point"), ("X.Y", "Handler"), ("X.Y", "Kind")}
    names = {n for _, n in mentioned}
    assert {"Serializable", "Base", "IThing", "Other", "Shape", "Result", "Arg", "Model", "Deep"} <= names
    assert not names & {"Not", "Neither", "Text", "Quoted", "Hidden", "class", "int"}
    assert {("", "Base"), ("X", "Base"), ("X.Y", "Base"), ("A.Tools", "Base"), ("A.C", "Deep"), ("X.A.C", "Deep"), ("A.B", "Model")} <= mentioned
    assert csharp.scan("") == (set(), set()) and csharp.scan("}}} class") == (set(), set())


def test_csharp_graph(spark):
    rows = [("g", "a.cs", "namespace N { class A { B b; } }"), ("g", "b.cs", "namespace N { partial class B { } }"), ("g", "b2.cs", "namespace N { partial class B { A a; } }"), ("g", "obj/c.cs", "namespace N { class C { A a; } }"), ("g", "d.cs", None), ("h", "a.cs", "namespace N { class Z { B b; } }")]
    got = csharp.type_graph(spark.createDataFrame(rows, "graph_id string, path string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [("g", "a.cs", "b.cs"), ("g", "a.cs", "b2.cs"), ("g", "b2.cs", "a.cs")]


def test_archive(tmp_path):
    from ringweave.sources import sinks

    assert sinks.archive_raw(str(tmp_path)) == [] and not list(tmp_path.iterdir())
    (tmp_path / "metrics.json").write_text("{}")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.xml").write_text("<x/>")
    (tmp_path / "raw_artifacts.tar.gz").write_text("old")
    assert sinks.archive_raw(str(tmp_path)) == ["d"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["metrics.json", "raw_artifacts.tar.gz"]
    with tarfile.open(tmp_path / "raw_artifacts.tar.gz") as t:
        assert t.extractfile("d/x.xml").read() == b"<x/>"


def test_jitter_is_bounded_and_steady(spark):
    rows = spark.range(50).withColumn("c", F.lit(3.0))
    draw = lambda seed, n: {r["id"]: r["x"] for r in rows.repartition(n).select("id", stats.bounded_jitter(F.col("id"), F.col("c"), 0.2, seed).alias("x")).collect()}
    a = draw(5, 1)
    assert a == draw(5, 4) != draw(6, 1)
    assert min(a.values()) >= 2.8 and max(a.values()) <= 3.2 and len(set(a.values())) == 50


def pooled(spark, cycle, won, trials, x, repo=None):
    import pandas as pd

    rows = pd.DataFrame({"cycle_id": cycle, "repo": cycle * 0 if repo is None else repo, "successes": won, "trials": trials, "x": x})
    df = spark.createDataFrame(rows).repartition(5)
    if repo is None:
        groups = stats._alike(df, [F.col("x")], ["cycle_id"], []).select(F.array(F.struct("rows", "n")).alias("groups"))
    else:
        groups = stats._alike(df, [F.col("x")], ["repo", "cycle_id"], ["repo"]).groupBy("repo").agg(F.collect_list(F.struct("rows", "n")).alias("groups"))
    return stats.PooledGlmm(stats.stored(groups, "units"), 1, repo is not None)


def test_models_in_spark_equal_those_in_memory(spark):
    rng = np.random.default_rng(6)
    cycle, x = np.repeat(np.arange(4000), 2), np.tile([0.0, 1.0], 4000)
    trials = rng.integers(1, 16, 8000)
    won = rng.binomial(trials, 1 / (1 + np.exp(-(-0.7 + 0.5 * x + rng.normal(0, 1.1, 4000)[cycle]))))
    a, b = pooled(spark, cycle, won, trials, x).fit(), stats.Glmm(cycle, won, trials, x).fit()
    assert a.p == pytest.approx(b.p, abs=1e-6) and a.se == pytest.approx(b.se, abs=1e-4) and a.ll == pytest.approx(b.ll, rel=1e-9)
    repo = np.repeat(np.arange(40), 200)
    won = rng.binomial(trials, 1 / (1 + np.exp(-(0.4 * x + rng.normal(0, 0.8, 4000)[cycle] + rng.normal(0, 0.6, 40)[repo]))))
    a, b = pooled(spark, cycle, won, trials, x, repo), stats.Glmm(cycle, won, trials, x, repo)
    p = np.array([0.1, 0.3, -0.2, -0.6])
    assert a.loglik(p) == pytest.approx(b.loglik(p), rel=1e-10)
    assert a.fit().p == pytest.approx(b.fit().p, abs=1e-5)


def test_models_of_nothing(spark):
    empty = spark.createDataFrame([], f"groups array<struct<rows:{stats._ROWS},n:double>>")
    assert stats.PooledGlmm(empty, 1).logliks([np.zeros(3), np.ones(3)]) == [0.0, 0.0]
    cols = "repo string, cycle_id string, mode_id string, success int, f double"
    same = spark.createDataFrame([("r", "c", "m", 0, 1.0), ("r", "c", "n", 1, 1.0)], cols)
    assert stats.single_factor_models(same, "m", {"F": ("f", False)})["coefficient"].isna().all()
    assert stats.configuration_model(same.limit(0), "m", "n")["coefficient"].isna().all()

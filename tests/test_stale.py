"""Stale references of patches over a shared base."""

from pyspark.sql import functions as F

from ringweave.operators import stale

RUNS = "run_id string, repo string, entry string, patch string"
FILES = "repo string, path string, text string"
BASE = [
    ("r", "src/pkg/__init__.py", ""),
    ("r", "src/pkg/a.py", "def f():\n    return 1\ndef g():\n    return f()"),
    ("r", "src/pkg/b.py", "from pkg.a import f\nfrom . import a\n"),
    ("r", "src/pkg/z.py", "x = 1\n"),
    ("r", "src/pkg/venv/v.py", "from pkg.a import f\n"),
    ("r", "src/other.py", "from pkg.a import f\n"),
    ("s", "src/pkg/b.py", "from pkg.a import f\nfrom . import a\n"),
]


def head(a, b=None):
    return f"diff --git a/{a} b/{b or a}\n--- a/{a}\n+++ b/{b or a}\n"


def found(spark, runs, base=BASE):
    files = spark.createDataFrame(base, FILES)
    given = stale.import_roots(spark.createDataFrame([(k, "r", "src/pkg", p) for k, p in runs], RUNS), files)
    return sorted(tuple(r[1:]) for r in stale.stale_references(given, files).collect())


MOVE = head("src/pkg/a.py") + "@@ -1,2 +1,0 @@\n-def f():\n-    return 1\n"
TAKE = head("src/pkg/z.py") + "@@ -1 +1,3 @@\n x = 1\n+def f():\n+    return 1\n"


def test_moved_symbol(spark):
    assert found(spark, [("1", MOVE + TAKE)]) == [
        ("stale_local_reference", "src/pkg/a.py", 2, "f", "moved", "pkg.a", "pkg.z", "src/pkg/a.py", "src/pkg/z.py"),
        ("stale_old_import", "src/pkg/b.py", 1, "f", "moved", "pkg.a", "pkg.z", "src/pkg/a.py", "src/pkg/z.py"),
    ]


def test_symbol_that_comes_back_is_not_stale(spark):
    again = head("src/pkg/a.py") + "@@ -1,2 +1,1 @@\n-def f():\n-    return 1\n+from pkg.z import f as f2\n" + TAKE
    assert [r[0] for r in found(spark, [("1", again)])] == ["stale_old_import"]
    assert found(spark, [("1", head("src/pkg/a.py") + "@@ -1,1 +1,1 @@\n-def f():\n+def f(x=1):\n")]) == []


def test_deleted_symbol_of_a_patch_that_does_not_fit(spark):
    odd = head("src/pkg/a.py") + "@@ -1,2 +1,0 @@\n-def f():\n-    return 2\n"
    assert [r[:5] for r in found(spark, [("1", odd)])] == [("stale_old_import", "src/pkg/b.py", 1, "f", "deleted")]


def test_dropped_import(spark):
    base = BASE + [("r", "src/pkg/c.py", "import os\nimport json\ng = lambda *json, **kw: json\nprint(os)\n")]
    drop = head("src/pkg/c.py") + "@@ -1,2 +1,0 @@\n-import os\n-import json\n"
    assert [r[:4] for r in found(spark, [("1", drop)], base)] == [("removed_import_used", "src/pkg/c.py", 2, "os")]


def test_nothing_to_look_at(spark):
    assert found(spark, [("1", None), ("2", ""), ("3", "no patch"), ("4", head("README.md") + "@@ -1 +1 @@\n-def f():\n")]) == []
    assert found(spark, [("1", MOVE)], [("r", "src/pkg/a.py", None)]) == []


def test_each_text_is_parsed_once(spark):
    """Ten runs over two repositories: Python gets each distinct text once, whatever the runs and copies."""
    files = spark.createDataFrame(BASE, FILES)
    runs = spark.createDataFrame([(str(k), "r", "src/pkg", MOVE + TAKE) for k in range(10)], RUNS)
    changed = stale.changed_files(stale.import_roots(runs, files).select("run_id", "repo", "patch"), files)
    assert changed.count() == 20  # a row for each run and file of its patch, not for each file of its repository
    texts = files.select("text", F.lit(False).alias("full")).unionByName(changed.where("post is not null").select(F.col("post").alias("text"), F.lit(True).alias("full")))
    once = stale.distinct_texts(texts).collect()
    assert texts.count() > 2 * len(once)
    assert sorted(r["text"] for r in once) == sorted({r["text"] for r in texts.where("text <> ''").collect()})
    assert sum(r["full"] for r in once) == 2
    assert {r["symbol"] for r in stale.text_facts(texts).where("what = 'export'").collect()} == {"f", "g", "x"}


def test_base_is_not_multiplied_by_runs(spark):
    """No join on the repository alone: the plan's Python nodes read patches' files and distinct texts."""
    files = spark.createDataFrame(BASE, FILES)
    runs = spark.createDataFrame([(str(k), "r", "src/pkg", MOVE + TAKE) for k in range(3)], RUNS)
    plan = stale.stale_references(stale.import_roots(runs, files), files)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan  # both passes are stored before

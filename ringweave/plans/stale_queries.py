"""Stale references: conversations stand in for runs, with repositories and patches made of their numbers and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stale, tables
from ..session import stored
from .facts import register, sql_pct, table

Q: dict = {}
SQL: dict[str, str] = {}


def _talks(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("text"))), F.lit("")).alias("first"))
    return talk.withColumn("r", F.expr("c div 8"))


def _names():
    """Columns: the repository's symbols, that which its runs move, and the comments at the top of its module."""
    symbol = lambda k: F.concat(F.lit("f"), F.col("r").cast("string"), F.lit(f"_{k}"))
    return [symbol(k) for k in range(4)], F.expr("(r div 2) % 4"), F.col("r") % 5


def _sources(talks):
    """repo, path, text: a module of four functions, files that import them by their full name or relatively, and files that aren't to be looked at.

    Every other repository is a package, so its modules have other names.
    """
    (s0, s1, s2, s3), _, top = _names()
    words = F.left(F.regexp_replace("first", r"[^\p{L}\p{N} ]", " "), F.lit(40))
    repos = talks.groupBy("r").agg(F.min_by(words, "c").alias("words"))
    lit, text = F.lit, F.concat
    functions = [x for s in (s0, s1, s2, s3) for x in (lit("def "), s, lit("(x):\n    return os\n\n"))]
    a = text(F.repeat(text(lit("# "), F.col("words"), lit("\n")), top.cast("int")), lit("import os\n"), *functions, lit("def use():\n    return "), s1, lit("("), s2, lit(")\n"))
    far = text(lit("from pkg.a import "), s0, lit("\n"))
    made = {
        "pkg/a.py": a,
        "pkg/b.py": text(lit("from pkg.a import "), s0, lit(", "), s1, lit(" as other\nfrom .a import "), s2, lit("\nprint("), s0, lit(", other, "), s2, lit(")\n")),
        "pkg/sub/c.py": text(lit("from ..a import "), s3, lit("\nif True:\n    from pkg.a import "), s0, lit("\n    print("), s0, lit(", "), s3, lit(")\n")),
        "pkg/d.py": lit("import json\nimport os.path as osp\ndef keep():\n    return json.dumps(osp)\n"),
        "pkg/build/x.py": far, "other/y.py": far, "pkg/odd.py": lit("def (\n"), "pkg/__init__.py": F.when(F.col("r") % 2 == 0, ""),
    }
    return repos.select(F.col("r").alias("repo"), F.explode(F.array(*[F.struct(lit(p).alias("path"), t.alias("text")) for p, t in made.items()])).alias("s")).select("repo", "s.*").where("text is not null")


def _runs(talks):
    """run_id, repo, entry, patch. A symbol is moved, deleted, moved with one importer mended, deleted by a patch that doesn't
    fit, or given another parameter beside a new file; or an import is dropped, or a file renamed; or there is no patch."""
    symbols, k, top = _names()
    m, lit, text = F.col("c") % 8, F.lit, F.concat
    s = F.element_at(F.array(*symbols), (k + 1).cast("int"))
    s0, s1, s2, _ = symbols
    n = lambda x: x.cast("string")
    head = lambda a, b=None: f"diff --git a/{a} b/{b or a}\nindex 1..2 100644\n--- a/{a}\n+++ b/{b or a}\n"
    at = n(top + 2 + 3 * k)
    took = lambda body: text(lit(head("pkg/a.py") + "@@ -"), at, lit(",3 +"), at, lit(",0 @@\n-def "), s, lit(f"(x):\n-    return {body}\n-\n"))
    gave = text(lit(head("pkg/d.py") + "@@ -4,1 +4,3 @@\n     return json.dumps(osp)\n+def "), s, lit("(x):\n+    return os\n"))
    mended = text(lit(head("pkg/b.py") + "@@ -1,2 +1,1 @@\n-from pkg.a import "), s0, lit(", "), s1, lit(" as other\n-from .a import "), s2, lit("\n+from .d import "), s0, lit(", "), s2, lit("\n"))
    wider = text(lit(head("pkg/a.py") + "@@ -"), at, lit(",1 +"), at, lit(",1 @@\n-def "), s, lit("(x):\n+def "), s, lit("(x, y):\n"))
    new = text(lit("diff --git a/pkg/new.py b/pkg/new.py\nnew file mode 100644\n--- /dev/null\n+++ b/pkg/new.py\n@@ -0,0 +1,1 @@\n+from .a import "), s2, lit("\n\\ No newline at end of file\n"))
    patch = (
        F.when(m == 0, text(took("os"), gave)).when(m == 1, took("os")).when(m == 2, text(took("os"), mended, gave))
        .when(m == 3, head("pkg/d.py") + "@@ -1,2 +1,1 @@\n-import json\n import os.path as osp\n").when(m == 4, took("something else"))
        .when(m == 5, "diff --git a/pkg/a.py b/pkg/e.py\nsimilarity index 100%\nrename from pkg/a.py\nrename to pkg/e.py\n").when(m == 7, text(wider, new))
    )
    return talks.select(F.col("c").alias("run_id"), F.col("r").alias("repo"), F.lit("pkg/").alias("entry"), patch.alias("patch"))


def _found(spark, sf_dir):
    talks = _talks(spark, sf_dir)
    files = stored(_sources(talks), "sources")
    return stale.stale_references(stale.import_roots(_runs(talks), files), files)


_FINDINGS = """WITH t AS (SELECT DISTINCT conv_id AS c, conv_id // 8 AS r, conv_id % 8 AS m, (conv_id // 16) % 4 AS k, (conv_id // 8) % 5 AS top, (conv_id // 8) % 2 = 0 AS named FROM conversations),
x AS (SELECT *, 'f' || r || '_' || k AS s, CASE WHEN named THEN 'pkg.' ELSE '' END AS pre, CASE WHEN m IN (0, 2) THEN 'moved' ELSE 'deleted' END AS removal FROM t),
o AS (SELECT x.*, path, line FROM x JOIN (VALUES (0, 'pkg/b.py', 1, TRUE), (0, 'pkg/sub/c.py', 3, TRUE), (1, 'pkg/b.py', 1, TRUE), (2, 'pkg/b.py', 2, FALSE), (3, 'pkg/sub/c.py', 1, FALSE)) AS w(v, path, line, full_name) ON k = v
  WHERE m IN (0, 1, 2, 4) AND (named OR NOT full_name) AND NOT (m = 2 AND path = 'pkg/b.py')),
found AS (
  SELECT c AS run_id, 'stale_old_import' AS kind, path, line::INTEGER AS line, s AS symbol, removal, pre || 'a' AS old_module, CASE WHEN removal = 'moved' THEN pre || 'd' ELSE '' END AS new_module FROM o
  UNION ALL SELECT c, 'stale_local_reference', 'pkg/a.py', top + 12, s, removal, pre || 'a', pre || 'd' FROM x WHERE m IN (0, 2) AND k IN (1, 2)
  UNION ALL SELECT c, 'removed_import_used', 'pkg/b.py', 2, 'other', 'import_removed', 'pkg.a', '' FROM x WHERE m = 2
  UNION ALL SELECT c, 'removed_import_used', 'pkg/d.py', 3, 'json', 'import_removed', 'json', '' FROM x WHERE m = 3)"""


@register(Q, SQL, _FINDINGS + " SELECT * FROM found")
def stale_references(spark, sf_dir):
    return _found(spark, sf_dir).select("run_id", "kind", "path", "line", "symbol", "removal", "old_module", F.coalesce("new_module", F.lit("")).alias("new_module"))


@register(Q, SQL, f"""{_FINDINGS}, p AS (SELECT run_id, bool_or(kind = 'stale_old_import') AS a, bool_or(kind = 'stale_local_reference') AS b, bool_or(kind = 'removed_import_used') AS d FROM found GROUP BY ALL),
n AS (SELECT 'mode ' || (c % 3) AS mode_id, count(*) AS runs, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (d) AS d, count(*) FILTER (a OR b OR d) AS x FROM t LEFT JOIN p ON run_id = c GROUP BY ALL)
SELECT mode_id, runs::BIGINT AS runs, a::BIGINT AS stale_old_import, b::BIGINT AS stale_local_reference, d::BIGINT AS removed_import_used, x::BIGINT AS any_risk, {sql_pct("x", "runs")} AS any_pct FROM n""")  # fmt: skip
def stale_risk(spark, sf_dir):
    failed = _talks(spark, sf_dir).select(F.col("c").alias("run_id"), F.concat(F.lit("mode "), (F.col("c") % 3).cast("string")).alias("mode_id"))
    return tables.stale_risk(failed, _found(spark, sf_dir), ["run_id"])

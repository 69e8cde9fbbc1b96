"""The fact table from artifacts: conversations stand in for the runs of a plan, and tell what each has left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import assemble, planning
from ..session import stored
from ..sources import config
from .facts import register, table

Q: dict = {}
SQL: dict[str, str] = {}

ROOT = "results"
#: The plan: two modes of two experiments. A cycle has four conversations, one for each of its runs.
PLAN = {"modes": [{"id": "none", "label": "No explanation", "experiments": ["e0", "e1"]}, {"id": "advisory", "label": "Advisory", "experiments": ["e0", "e1"]}]}


def _conversations(spark, sf_dir):
    """c, turns, asked, chars, first of the conversations of whole cycles, with their cycle k, repository r and run."""
    talk = table(spark, sf_dir, "conversations")
    one = talk.groupBy(F.col("conv_id").alias("c")).agg(
        F.count("*").alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("asked"), F.sum(F.length("text")).alias("chars"), F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("text"))), F.lit("")).alias("first")
    )
    numbered = one.withColumns({"k": F.expr("c div 4"), "m": F.col("c") % 4})
    whole = numbered.groupBy("k").agg(F.count("*").alias("n")).where("n = 4").select("k")
    rows = numbered.join(whole, "k").withColumns({"r": F.expr("k div 3"), "mode_id": F.when(F.col("m") < 2, "none").otherwise("advisory"), "experiment_id": F.concat(F.lit("e"), (F.col("m") % 2).cast("string"))})
    names = {"repo": F.concat(F.lit("repo"), F.col("r").cast("string")), "cycle_id": F.concat(F.lit("scc_"), (F.col("k") % 3).cast("string"), F.lit("_cycle_"), F.col("k").cast("string"))}
    return rows.withColumns(names)


def _json(*parts):
    """A JSON text of fixed pieces and columns."""
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _edge(a: int, b: int) -> str:
    return f'{{"source":"m{a}","target":"m{b}"}}'


def _graph(*edges):
    """A dependency graph of the edges (a, b, whether)."""
    some = F.array_compact(F.array(*[F.when(on, F.lit(_edge(a, b))) for a, b, on in edges]))
    return _json('{"schema_version":1,"nodes":[],"edges":[', F.array_join(some, ","), "]}")


def _component(name: str, nodes: str, edge_count, edges: str = ""):
    ids = ",".join(f'{{"id":"m{n}"}}' if n != "0" else '"m0"' for n in nodes)
    return _json(f'{{"id":"{name}","size":{len(nodes)},"edge_count":', edge_count.cast("string"), f',"nodes":[{ids}],"edges":[{edges}]}}')


def _report(*components):
    """A component report of the components (whether, text)."""
    return _json('{"sccs":[', F.array_join(F.array_compact(F.array(*[F.when(on, text) for on, text in components])), ","), "]}")


def _files(runs):
    """path and text of all artifacts."""
    r, c, always = F.col("r"), F.col("c"), F.lit(True)
    chord, loop = r % 2 == 1, r % 3 == 0
    one = lambda cond: F.when(cond, 1).otherwise(0)
    at = lambda branch, kind: E.artifact_path(F.lit(ROOT), "repo", branch, kind)
    record = (
        F.when(F.col("k") % 3 == 0, _json('{"id":"', F.col("cycle_id"), f'","length":3,"edges":[{_edge(0, 1)},{_edge(1, 2)},{_edge(2, 0)}]}}'))
        .when(F.col("k") % 3 == 1, _json('{"id":"', F.col("cycle_id"), '","length":2.0,"nodes":["m3",{"id":"m4"}]}'))
        .otherwise(_json('{"id":"', F.col("cycle_id"), '","path":["m5"]}'))
    )
    cycles = runs.where("m = 0").groupBy("r", "repo").agg(F.array_join(F.sort_array(F.collect_list(record)), ",").alias("records"))
    ring = [(0, 1, always), (1, 2, always), (2, 0, always), (1, 0, chord), (3, 4, always), (4, 3, always), (5, 5, loop)]
    base_report = _report((always, _component("scc_0", "012", 3 + one(chord))), (always, _component("scc_1", "34", F.lit(2))), (loop, _component("scc_2", "5", F.lit(1), _edge(5, 5))))
    counts = _json('{"tests":10,"failures":', (r % 3).cast("string"), ',"errors":0,"skipped":1}')
    tests = F.when(r % 6 == 5, "{bad").when(r % 4 == 1, _json('{"dotnet_test":', counts, "}")).otherwise(_json('{"pytest":', counts, "}"))
    base = [
        (assemble.METRICS, r % 8 != 7, tests), (assemble.GRAPH, r % 9 != 8, _graph(*ring)), (assemble.REPORT, r % 5 != 4, base_report),
        (assemble.CATALOG, r % 7 != 3, _json('{"schema_version":1,"sccs":[{"id":"scc_0","cycles":[', F.col("records"), "]}]}")),
    ]
    broken, parted, wide = F.col("chars") % 3 == 0, F.col("chars") % 4 == 0, F.col("turns") % 5 == 0
    edges = [(0, 1, ~broken), *ring[1:5], (4, 3, ~parted), ring[6], (0, 5, wide), (5, 0, wide)]
    post_report = _report(
        (~broken & wide, _component("scc_0", "0125", 5 + one(chord) + one(loop))), (~broken & ~wide, _component("scc_0", "012", 3 + one(chord))), (broken & wide, _component("scc_0", "05", 2 + one(loop))),
        (~parted, _component("scc_1", "34", F.lit(2))), (~wide & loop, _component("scc_2", "5", F.lit(1), _edge(5, 5))),
    )
    ended = c % 10 != 3
    passed = _json('{"pytest":{"tests":10,"failures":', (F.col("asked") % 3).cast("string"), ',"errors":0,"skipped":1},"dotnet_test":null}')
    lines = F.array_join(F.transform(E.lines_of("first"), lambda x: F.concat(F.lit("+"), x)), "\n")
    name = (c % 5).cast("string")
    patch = _json("diff --git a/f", name, ".py b/", F.when(c % 2 == 0, "f").otherwise("g"), name, ".py\nindex 1..2 100644\n--- a/f", name, ".py\n@@ -1,0 +1,9 @@\n", lines, "\n")
    prompt = _json("Task.\n", F.when(c % 7 == 5, "no anchor").otherwise(F.lit(E.EXPLANATION_ANCHOR)), "\n\n ", F.col("first"))
    post = [
        (assemble.METRICS, c % 17 != 0, F.when(c % 19 == 0, "[1, 2").otherwise(passed)), (assemble.GRAPH, ended, _graph(*edges)), (assemble.REPORT, ended & (c % 10 != 6), post_report),
        (assemble.STATUS, (c % 23 != 0) | ~ended, F.when(c % 29 == 0, "outcome: lost").when(ended, '{"outcome": " done "}').otherwise('{"outcome": "no_changes"}')),
        (assemble.PROMPT, (F.col("mode_id") == "advisory") | (c % 3 != 0), prompt), (assemble.PATCH, ended, patch),
    ]

    def written(rows, branch, kinds):
        files = F.array_compact(F.array(*[F.when(on, F.struct(at(branch, kind).alias("path"), text.alias("text"))) for kind, on, text in kinds]))
        return rows.select(F.explode(files).alias("f")).select("f.*")

    branch = E.refactor_branch("experiment_id", "mode_id", "cycle_id")
    return written(cycles, F.lit("main"), base).unionByName(written(runs, branch, post))


_EDGES = """SELECT c, unnest(list_filter([
    CASE WHEN chars % 3 <> 0 THEN [0, 1] END, [1, 2], [2, 0], CASE WHEN r % 2 = 1 THEN [1, 0] END, [3, 4], CASE WHEN chars % 4 <> 0 THEN [4, 3] END,
    CASE WHEN r % 3 = 0 THEN [5, 5] END, CASE WHEN turns % 5 = 0 THEN [0, 5] END, CASE WHEN turns % 5 = 0 THEN [5, 0] END], lambda e: e IS NOT NULL)) AS e FROM runs"""


@register(Q, SQL, f"""
WITH RECURSIVE one AS (
  SELECT conv_id AS c, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sum(length(text)) AS chars, coalesce(max(text) FILTER (turn = 0), '') AS first FROM conversations GROUP BY conv_id
), runs AS (
  SELECT *, c // 4 AS k, c // 12 AS r, c % 4 AS m FROM one QUALIFY count(*) OVER (PARTITION BY c // 4) = 4
), edges AS (SELECT c, e[1] AS src, e[2] AS dst FROM ({_EDGES})
), reach AS (
  SELECT c, src AS a, dst AS b FROM edges UNION SELECT x.c, x.a, e.dst FROM reach x JOIN edges e ON x.c = e.c AND x.b = e.src
), members AS (
  SELECT x.c, x.a AS node, min(x.b) AS comp FROM reach x JOIN reach y ON x.c = y.c AND x.a = y.b AND x.b = y.a GROUP BY x.c, x.a
), comps AS (
  SELECT c, comp, n, (SELECT count(*) FROM edges e JOIN members a ON a.c = e.c AND a.node = e.src JOIN members b ON b.c = e.c AND b.node = e.dst WHERE e.c = g.c AND a.comp = g.comp AND b.comp = g.comp) AS inside
  FROM (SELECT c, comp, count(*) AS n FROM members GROUP BY ALL) g
), target AS (
  SELECT c, unnest(CASE k % 3 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [3, 4] WHEN 2 THEN CASE WHEN r % 3 = 0 THEN [5] ELSE [] END END) AS node FROM runs
), near AS (
  SELECT c, count(*) AS n, sum(greatest(0, inside - comps.n)) AS post_local FROM (SELECT DISTINCT t.c, comp FROM target t JOIN members m ON m.c = t.c AND m.node = t.node) JOIN comps USING (c, comp) GROUP BY c
), flags AS (
  SELECT r.*, coalesce(near.n, 0) AS near, coalesce(post_local, 0) AS post_local, CASE WHEN k % 3 = 0 THEN r % 2 ELSE 0 END AS base_local, NOT (k % 3 = 2 AND r % 3 <> 0) AS known,
    CASE WHEN (c % 23 = 0 AND c % 10 <> 3) OR c % 29 = 0 THEN '' WHEN c % 10 = 3 THEN 'no_changes' ELSE 'done' END AS outcome,
    r % 5 <> 4 AND r % 7 <> 3 AS based, r % 9 <> 8 AS drawn, c % 10 <> 3 AS ended, c % 10 <> 6 AS reported,
    r % 6 <> 5 AND r % 8 <> 7 AND c % 17 <> 0 AND c % 19 <> 0 AND asked % 3 <= r % 3 AS kept, turns % 5 = 0 AS wide
  FROM runs r LEFT JOIN near USING (c)
), judged AS (
  SELECT *, based AND ended AND reported AS normal, based AND drawn AND outcome = 'no_changes' AS same FROM flags
), told AS (
  SELECT *, normal AND known AS on_it,
    (CASE WHEN chars % 3 <> 0 AND wide THEN greatest(0, 1 + r % 2 + (r % 3 = 0)::INTEGER) WHEN chars % 3 <> 0 THEN r % 2 WHEN wide THEN (r % 3 = 0)::INTEGER ELSE 0 END) AS post_red
  FROM judged
), raw AS (
  SELECT *, on_it AND ((k % 3 = 0 AND chars % 3 = 0) OR (k % 3 = 1 AND chars % 4 = 0)) AS gone, on_it AND near <> 1 AND post_local < base_local AS better, on_it AND near = 1 AND post_local < base_local AS weaker,
    on_it AND wide AND r % 3 <> 0 AS outside, on_it AND (post_red > r % 2 OR (wide AND r % 3 <> 0)) AS worse, string_split(regexp_replace(first, '\\n$', ''), chr(10)) AS lines
  FROM told
)
SELECT CASE WHEN m < 2 THEN 'none' ELSE 'advisory' END AS mode_id, 'e' || (m % 2) AS experiment_id, 'repo' || r AS repo, 'scc_' || (k % 3) || '_cycle_' || k AS cycle_id, CASE WHEN r % 2 = 0 THEN 'python' ELSE 'csharp' END AS language,
  outcome AS openhands_outcome, (outcome = 'no_changes')::INTEGER AS no_change, (NOT (normal OR same))::INTEGER AS other_incomplete, (normal OR same)::INTEGER AS structurally_evaluable, kept::INTEGER AS behavior_preserved,
  (kept AND gone)::INTEGER AS cycle_broken, (kept AND (normal OR same) AND (better OR weaker))::INTEGER AS local_improvement, (kept AND gone AND (better OR weaker) AND NOT worse)::INTEGER AS success,
  coalesce(CASE WHEN r % 7 <> 3 THEN CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 END END, -1)::BIGINT AS cycle_size, gone::INTEGER AS cycle_eliminated_raw, better::INTEGER AS structural_improvement_raw, weaker::INTEGER AS weakening_improvement_raw,
  worse::INTEGER AS global_structural_regression_raw, outside::INTEGER AS global_regression_outside_target_raw,
  CASE WHEN on_it OR (same AND NOT normal AND known) THEN r % 2 ELSE 0 END::BIGINT AS baseline_global_redundancy, CASE WHEN on_it THEN post_red WHEN same AND NOT normal AND known THEN r % 2 ELSE 0 END::BIGINT AS post_global_redundancy,
  coalesce(CASE WHEN (m >= 2 OR c % 3 <> 0) AND c % 7 <> 5 THEN length(regexp_replace(first, '^\\s+', '')) END, -1)::BIGINT AS explanation_chars,
  CASE WHEN NOT ended THEN -1 WHEN c % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS files_modified,
  CASE WHEN ended THEN coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT starts_with(x, '++')), lambda x: length(x))), 0) ELSE -1 END::BIGINT AS chars_changed
FROM raw""")  # fmt: skip
def run_artifacts(spark, sf_dir):
    """A plan's runs assembled from the artifacts that they and their repositories' baselines have left; -1 where a file says nothing."""
    runs = stored(_conversations(spark, sf_dir), "conversations")
    repos = runs.select("r", "repo").distinct().select("repo", F.lit("main").alias("base_branch"), F.lit("src").alias("entry"), F.when(F.col("r") % 2 == 0, "python").otherwise("csharp").alias("language"))
    cycles = runs.where("m = 0").select("repo", F.lit("main").alias("base_branch"), "cycle_id")
    planned = planning.planned_runs(config.analysis_plan(spark, PLAN), cycles, repos, ROOT)
    got = assemble.assemble_runs(planned, assemble.routed(_files(runs)))
    counts = ("cycle_size", "explanation_chars", "files_modified", "chars_changed")
    values = [F.coalesce(c, F.lit(-1).cast("long")).alias(c) if c in counts else c for c in assemble.OUTCOMES]
    return got.select("mode_id", "experiment_id", "repo", "cycle_id", "language", *values)

"""Phases and their statuses, plans, files written and read back, prompts, Python sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import context, csharp, planning, pyast, stats, status, tables
from ..session import fresh_path, spread
from ..sources import config, graphs, sinks
from ..sources import text as S
from .facts import register, sql_pct, table

Q: dict = {}
SQL: dict[str, str] = {}

# statuses -----------------------------------------------------------------------------------------------------


def _log(spark, sf_dir):
    """Events as statuses: a user's events are phases of a unit."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "ok").otherwise("failed")
    return e.select("user_id", F.when(F.col("event_id") % 2 == 0, "explain").otherwise("metrics").alias("phase"), F.struct("ts", "event_id").alias("ts"), outcome.alias("outcome"))


_LAST = "SELECT user_id, arg_max(event_type, (ts, event_id)) = 'purchase' AS ok FROM events WHERE event_id % 2 = 0 GROUP BY ALL"


@register(Q, SQL, f"SELECT user_id FROM (SELECT DISTINCT user_id FROM events) JOIN ({_LAST}) USING (user_id) WHERE ok")
def phase_gate(spark, sf_dir):
    return status.gate(table(spark, sf_dir, "events").select("user_id").distinct(), _log(spark, sf_dir), ["user_id"], "explain")


@register(Q, SQL, """WITH u AS (SELECT c_custkey, c_custkey % 3 = 0 AS done, c_nationkey AS old, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS new FROM customer)
SELECT c_custkey, CASE WHEN done THEN 'touched' ELSE 'not run' END AS violation FROM u WHERE done = (old IS DISTINCT FROM new)""")  # fmt: skip
def resume_violations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    before = c.select(k, F.when(k % 3 == 0, "ok").when(k % 3 == 1, "failed").alias("outcome"), n.alias("mtime"))
    after = c.where(k % 5 != 0).select(k, F.when(k % 4 == 0, n + 1).otherwise(n).alias("mtime"))
    return status.resume_violations(before, after, ["c_custkey"]).select("c_custkey", "violation")


@register(Q, SQL, "SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'and')")
def midrun_edits(spark, sf_dir):
    return status.midrun_edits(table(spark, sf_dir, "documents").select("doc_id", "text"), ("the", "and")).select("doc_id")


@register(Q, SQL, """WITH u AS (SELECT c_custkey, c_custkey % 2 = 0 AS committed, CASE c_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' END AS metrics FROM customer)
SELECT c_custkey, CASE WHEN committed THEN 'ok' ELSE 'skipped' END AS expected, metrics FROM u WHERE metrics IS DISTINCT FROM (CASE WHEN committed THEN 'ok' ELSE 'skipped' END)""")  # fmt: skip
def expected_metrics(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), F.col("c_nationkey") % 3
    refactor = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "committed").otherwise("no_changes").alias("outcome"))
    metrics = c.where(n < 2).select("c_custkey", F.when(n == 0, "ok").otherwise("skipped").alias("outcome"))
    return status.expect_metrics(c.select("c_custkey"), refactor, metrics, ["c_custkey"]).select("c_custkey", "expected", "metrics")


@register(Q, SQL, "SELECT c_custkey, 'metrics' AS phase, 'skipped' AS outcome, 'missing_branch' AS reason FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def skipped_rows(spark, sf_dir):
    branches = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return status.skipped_rows(table(spark, sf_dir, "customer").select("c_custkey"), branches, ["c_custkey"], "metrics")


def _outcomes(spark, sf_dir):
    """What three phases would give for each conversation, in order; from half of a phase's units on some are blocked."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    c = F.col("conv_id")
    outcome = F.when((F.col("chars") % 97 == 0) & (c % 2 == 0), "blocked").when(F.col("turns") > 6, "failed").when(F.col("turns") == 1, "skipped").otherwise("ok")
    return talk.select(c.alias("unit"), F.concat(F.lit("phase "), (c % 3).cast("string")).alias("phase"), c.alias("ord"), outcome.alias("outcome"), F.when(outcome == "blocked", "llm_unavailable").otherwise("").alias("reason"))


@register(Q, SQL, """WITH t AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY ALL),
o AS (SELECT conv_id AS unit, 'phase ' || (conv_id % 3) AS phase, conv_id AS ord, CASE WHEN chars % 97 = 0 AND conv_id % 2 = 0 THEN 'blocked' WHEN turns > 6 THEN 'failed' WHEN turns = 1 THEN 'skipped' ELSE 'ok' END AS outcome FROM t),
f AS (SELECT phase, min(ord) AS first FROM o WHERE outcome = 'blocked' GROUP BY ALL)
SELECT unit, phase, ord, outcome, CASE WHEN outcome = 'blocked' THEN 'llm_unavailable' ELSE '' END AS reason FROM o LEFT JOIN f USING (phase) WHERE first IS NULL OR ord <= first""")
def phase_run(spark, sf_dir):
    """Phases over the conversations that write their statuses as JSON lines and stop when blocked; the last of each unit, read back."""
    log = status.replay(_outcomes(spark, sf_dir))
    path = fresh_path(spark, "statuses")
    sinks.append_jsonl(log.where("outcome = 'started'"), path)
    sinks.append_jsonl(log.where("outcome <> 'started'"), path)
    read = S.read_jsonl(spark, path, "unit long, phase string, ord long, seq long, outcome string, reason string")
    return status.latest(read, ["unit", "phase", "ord"], ["seq"], ["outcome", "reason"])


@register(Q, SQL, """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'main' ELSE 'atd-e' || (doc_id % 3) || '-' || lang || '-' || doc_id END AS branch,
doc_id % 7 <> 0 AND starts_with('atd-e' || (doc_id % 3) || '-', 'atd-e' || (length(source) % 3) || '-') AS deletable FROM documents""")
def deletable_branches(spark, sf_dir):
    k = F.col("doc_id")
    branch = F.when(k % 7 == 0, "main").otherwise(F.concat(F.lit("atd-e"), (k % 3).cast("string"), F.lit("-"), "lang", F.lit("-"), k.cast("string")))
    experiment = F.concat(F.lit("e"), (F.length("source") % 3).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", branch.alias("branch"), status.deletable(branch, F.lit("main"), experiment).alias("deletable"))


@register(Q, SQL, """WITH f AS (SELECT conv_id, turn, role, coalesce(text, '') AS was, CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN text || '!' ELSE text END AS now, conv_id % 11 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id) AS gone FROM conversations),
u AS (SELECT conv_id, conv_id % 5 <> 0 AS ok, bool_or(gone) OR bool_or(was IS DISTINCT FROM now) AS touched FROM f GROUP BY ALL) SELECT conv_id FROM u WHERE NOT ok OR touched""")
def resume_by_content(spark, sf_dir):
    """Conversations as units, users' turns as their inputs and the others as outputs. Some have been edited since, some
    have lost their last turn, and some had failed: those alone run again."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "input").otherwise("output").alias("role"), F.col("turn").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    edited = talk.withColumn("text", F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    last = talk.groupBy("conv_id").agg(F.max("turn").alias("turn")).where("conv_id % 11 = 0")
    now = edited.join(last, ["conv_id", "turn"], "left_anti")
    keys = ["conv_id", "role"]
    valid = status.unchanged(status.digests(talk, keys), status.digests(now, keys), ["conv_id"])
    units = talk.select("conv_id").distinct()
    log = units.select("conv_id", F.lit("explain").alias("phase"), F.lit(1).alias("ts"), F.when(F.col("conv_id") % 5 == 0, "failed").otherwise("ok").alias("outcome"))
    return status.to_run(units, log, ["conv_id"], "explain", valid)


@register(Q, SQL, """WITH m AS (SELECT mode_id, row_number() OVER (ORDER BY mode_id) - 1 AS mode_ord FROM (SELECT DISTINCT c_mktsegment AS mode_id FROM customer)), c AS (SELECT n_name, n_nationkey FROM nation)
SELECT n_name AS repo, mode_id, (row_number() OVER (ORDER BY n_nationkey, mode_ord) - 1)::INTEGER AS ord FROM c, m WHERE mode_id IN ('BUILDING', 'MACHINERY')""")  # fmt: skip
def experiment_units(spark, sf_dir):
    from pyspark.sql import Window

    modes = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("mode_id")).distinct()
    modes = modes.withColumn("mode_ord", F.row_number().over(Window.orderBy("mode_id")) - 1)  # five of them
    n = table(spark, sf_dir, "nation")
    cycles = n.select(F.col("n_name").alias("repo"), F.lit("main").alias("base_branch"), F.lit("scc_0_cycle_0").alias("cycle_id"), F.col("n_nationkey").alias("cycle_ord"))
    repos = n.select(F.col("n_name").alias("repo"), F.lit("main").alias("base_branch"), F.lit("src").alias("entry"), F.lit("python").alias("language"))
    return planning.experiment_units(cycles, repos, modes, ["BUILDING", "MACHINERY"]).select("repo", "mode_id", "ord")


@register(Q, SQL, """SELECT mode_id, 'label ' || mode_id AS mode_label, (row_number() OVER (ORDER BY mode_id DESC) - 1)::INTEGER AS mode_order, 'e1,e2' AS experiments, 'multi_agent' AS orchestrator, TRUE AS deletes
FROM (SELECT DISTINCT c_mktsegment AS mode_id FROM customer)""")  # fmt: skip
def configured_modes(spark, sf_dir):
    """An analysis plan and a pipeline's configuration with the market segments as modes."""
    names = sorted((r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect()), reverse=True)
    plan = config.analysis_plan(spark, {"modes": [{"id": n, "label": f"label {n}", "experiments": ["e1", "e2"]} for n in names]})
    given = dict.fromkeys(config.REQUIRED, "x") | {
        "policy": {"delete_refactor_branches_after_metrics": True},
        "llm": {"base_url": "u", "api_key": "k", "model_raw": "m", "context_length": 1},
        "openhands": {"runtime_image": "i", "max_iters": 1, "commit_message": "c"},
        "modes": [{"id": n, "params": {"orchestrator": "Multi_Agent"}} for n in names],
    }
    c = config.PipelineConfig.of(given)
    own = spark.createDataFrame([(n, dict(p)["orchestrator"], c.delete_branches) for n, p in c.modes], "mode_id string, orchestrator string, deletes boolean")
    return plan.withColumn("experiments", F.array_join("experiments", ",")).join(own, "mode_id")


# files --------------------------------------------------------------------------------------------------------


@register(Q, SQL, "SELECT c_mktsegment AS segment, count(*)::BIGINT AS runs, round(avg(c_acctbal), 2) AS balance, NULL::DOUBLE AS none FROM customer GROUP BY ALL")
def csv_files(spark, sf_dir):
    """A result table written as CSV twice, the second time over the first, and read back."""
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("runs"), F.round(F.avg("c_acctbal"), 2).alias("balance")).withColumn("none", F.lit(None).cast("double"))
    path = fresh_path(spark, "csv")
    sinks.write_csv(t.limit(0), path)
    sinks.write_csv(t, path, titles=True)
    back = S.read_csv(spark, path, "segment string, runs long, balance double, none double")
    return back


@register(Q, SQL, "SELECT n_name AS repo, 'main' AS base_branch, 'scc_0_cycle_' || n_nationkey AS cycle_id FROM nation WHERE n_nationkey % 2 = 0")
def selection_files(spark, sf_dir):
    """A selection written in the order of choice and read back."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    own = n.select(F.col("n_nationkey").alias("pick_no"), F.col("n_name").alias("repo"), F.lit("main").alias("base_branch"), F.concat(F.lit("scc_0_cycle_"), F.col("n_nationkey").cast("string")).alias("cycle_id"))
    path = fresh_path(spark, "selection")
    sinks.write_selection(own, path)
    return S.read_cycles(spark, path).select("repo", "base_branch", "cycle_id")


@register(Q, SQL, "SELECT 'scc_0_cycle_' || n_nationkey AS cycle_id FROM nation WHERE n_nationkey % 3 = 0")
def selected_cycles(spark, sf_dir):
    """The cycles of one repository and branch, of a list that repeats lines and has others and longer ones."""
    n = table(spark, sf_dir, "nation")
    repo = F.when(F.col("n_nationkey") % 3 == 0, "r main ").otherwise(F.when(F.col("n_nationkey") % 3 == 1, "q main ").otherwise("r dev "))
    line = F.concat(repo, F.lit("scc_0_cycle_"), F.col("n_nationkey").cast("string"))
    path = fresh_path(spark, "selection")
    n.select(F.explode(F.array(line, line, F.concat(line, F.lit("1 more")))).alias("value")).write.text(path)
    return S.selected_cycles(spark, path, "r", "main")


@register(Q, SQL, """SELECT p_brand AS graph_id, 'm' || p_partkey AS module, CASE WHEN p_partkey % 4 > 0 THEN 'm/' || p_partkey || '.py' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 'os,m1' ELSE '' END AS imports FROM part""")
def module_listings(spark, sf_dir):
    k = F.col("p_partkey")
    entry = F.struct(F.when(k % 4 > 0, F.concat(F.lit("m/"), k.cast("string"), F.lit(".py"))).alias("path"), F.when(k % 3 == 0, F.array(F.lit("os"), F.lit("m1"))).alias("imports"))
    pairs = F.collect_list(F.struct(F.concat(F.lit("m"), k.cast("string")), entry))
    raw = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("graph_id")).agg(F.to_json(F.map_from_entries(pairs)).alias("text"))
    return graphs.modules_of(raw).withColumn("imports", F.array_join("imports", ","))


@register(Q, SQL, "SELECT r_name AS repo, 'main' AS base_branch, 'src' AS entry, CASE WHEN r_regionkey % 2 = 0 THEN 'python' ELSE 'unknown' END AS language FROM region")
def repository_lists(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    line = F.concat(F.lit("  "), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("\tmain  src"), F.when(F.col("r_regionkey") % 2 == 0, " python").otherwise(""))
    path = fresh_path(spark, "repositories")
    r.select(F.explode(F.array(F.lit("# a comment"), F.lit(" "), line)).alias("value")).write.text(path)
    return S.read_repos(spark, path, strict=False).select(F.replace("repo", F.lit("_"), F.lit(" ")).alias("repo"), "base_branch", "entry", "language")


@register(Q, SQL, "SELECT n_regionkey, CASE WHEN n_regionkey % 3 <> 0 THEN n ELSE -1 END::BIGINT AS n FROM (SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY ALL)")
def json_documents(spark, sf_dir):
    """A document in a file of its own for each region; those that are broken or no objects are read as null."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    doc = F.when(F.col("n_regionkey") == 0, "[1]").when(F.col("n_regionkey") == 3, "no JSON").otherwise(F.to_json(F.struct("n")))
    path = fresh_path(spark, "documents")
    n.select("n_regionkey", doc.alias("value")).write.partitionBy("n_regionkey").text(path)
    read = S.read_json_documents(spark, path, "n long", "*.txt")
    return read.select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast(n.schema["n_regionkey"].dataType).alias("n_regionkey"), F.coalesce("doc.n", F.lit(-1).cast("long")).alias("n"))


@register(Q, SQL, "SELECT c_mktsegment AS segment, sum(c_nationkey)::BIGINT AS prompt_tokens FROM customer GROUP BY ALL")
def usage_summary(spark, sf_dir):
    path = fresh_path(spark, "usage")
    sinks.write_json(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("c_nationkey").alias("prompt_tokens")), path)
    return S.read_jsonl(spark, path, "segment string, prompt_tokens long")


@register(Q, SQL, """WITH g AS (SELECT source, doc_id // 40 AS block, bool_or(lang = 'en') AND bool_or(lang = 'fr') AND bool_or(quality = 1) AND bool_or(quality <> 1) AS fits FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') GROUP BY ALL)
SELECT source, block, unnest(['Configuration', 'Cycle random-effect variance']) AS effect, NULL::DOUBLE AS coefficient, NULL::DOUBLE AS odds_ratio, 'n/a' AS p FROM g WHERE NOT fits""")
def placeholder_rows(spark, sf_dir):
    """Labelled documents of two languages as runs of two modes, in groups by source and block."""
    runs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    facts = runs.select("source", F.expr("doc_id div 40").alias("block"), F.col("lang").alias("mode_id"), F.col("quality").alias("success"))
    return stats.placeholders(facts, ["source", "block"], "en", "fr", ["Configuration", "Cycle random-effect variance"])


@register(Q, SQL, """WITH p AS (SELECT p_brand AS repo, CASE WHEN p_partkey % 3 = 0 THEN 'a/' || p_type || '.csproj' WHEN p_partkey % 7 = 0 THEN p_name || '.SLN' ELSE p_name || '.cs' END AS path FROM part),
k AS (SELECT repo, path, CASE WHEN ends_with(path, '.SLN') THEN 0 WHEN ends_with(path, '.csproj') THEN 1 END AS k FROM p) SELECT repo, arg_min(path, (k, length(path), path)) AS path FROM k WHERE k IS NOT NULL GROUP BY ALL""")  # fmt: skip
def picked_projects(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("a/"), "p_type", F.lit(".csproj"))).when(k % 7 == 0, F.concat("p_name", F.lit(".SLN"))).otherwise(F.concat("p_name", F.lit(".cs")))
    return S.pick_project(table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), path.alias("path")))


_README = "SELECT 'r' || (page_id % 4) AS repo, repeat('d/', (page_id % 9)::INTEGER) || CASE WHEN page_id % 5 = 0 THEN 'notes.md' ELSE 'ReadMe' || page_id || '.md' END AS path FROM pages"


@register(Q, SQL, f"""SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY len(string_split(path, '/')), path)::INTEGER AS place FROM ({_README})
WHERE regexp_matches(lower(string_split(path, '/')[-1]), '^readme.*\\.md$') AND len(string_split(path, '/')) - 1 <= 6""")  # fmt: skip
def readme_order(spark, sf_dir):
    k = F.col("page_id")
    name = F.when(k % 5 == 0, "notes.md").otherwise(F.concat(F.lit("ReadMe"), k.cast("string"), F.lit(".md")))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("r"), (k % 4).cast("string")).alias("repo"), F.concat(F.repeat(F.lit("d/"), (k % 9).cast("int")), name).alias("path"))
    return S.find_readmes(p)


@register(Q, SQL, "SELECT n_name AS repo, n_name || '.py' AS node, 'x' AS text FROM nation WHERE n_nationkey % 2 = 0")
def cycle_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = F.concat("n_name", F.lit(".py"))
    files = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("repo"), path.alias("path"), F.lit("x").alias("text"))
    return S.cycle_files(files, n.select(F.col("n_name").alias("repo"), path.alias("node")))


@register(Q, SQL, """SELECT c_custkey FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 7 <> 0 AND NOT (c_custkey % 5 = 0 AND c_custkey % 3 <> 0)""")
def scanned_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    every = lambda n: c.where(F.col("c_custkey") % n == 0)
    return S.scan_files(every(2), every(3), every(5), every(7), ["c_custkey"])


# prompts ------------------------------------------------------------------------------------------------------


@register(Q, SQL, """WITH p AS (SELECT page_id % 5 AS k, regexp_replace(url, '^https?://', '') AS path FROM pages), f AS (SELECT DISTINCT k, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
n AS (SELECT k, CASE WHEN len(s) <= 1 THEN '(root)' ELSE s[1] END AS folder, count(*) AS n FROM f GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, folder) AS place, count(*) OVER (PARTITION BY k) AS all_of FROM n)
SELECT k, folder, n::BIGINT AS n, place::INTEGER AS place, greatest(all_of - 3, 0)::BIGINT AS omitted_folders FROM w WHERE place <= 3""")  # fmt: skip
def folder_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("k"), F.regexp_replace("url", "^https?://", "").alias("path"), F.lit("").alias("root"))
    return context.folder_counts(p, ["k"], "path", "root", 1, 3)


def _sql_block(path: str, text: str, tokens: str) -> str:
    """The text between its marks within so many tokens, as the engine's blocks."""
    head, foot, room = f"'--- BEGIN ' || {path} || ' ---' || chr(10)", f"chr(10) || '--- END ' || {path} || ' ---' || chr(10)", f"({tokens}) * 3"
    left = f"({room} - length({head}) - length({foot}))"
    return f"""CASE WHEN {room} <= 0 OR {left} < 0 THEN '' WHEN length({text}) <= {left} THEN {head} || {text} || {foot}
ELSE left({head} || left({text}, greatest({left} - 13, 0)) || chr(10) || '[Truncated]' || chr(10) || {foot}, {room}) END"""


@register(Q, SQL, f"""WITH e AS (SELECT p_partkey, p_brand AS src, p_type AS dst, repeat(p_name || ' ', 1 + p_partkey % 9) AS x, repeat(p_mfgr, 1 + p_partkey % 4) AS y, (p_partkey % 50)::BIGINT AS t FROM (SELECT *, p_type AS p_mfgr FROM part)),
n AS (SELECT *, (ceil(length(x) / 3.0::DOUBLE) + ceil((length(src) * 2 + 29) / 3.0::DOUBLE))::BIGINT AS na, (ceil(length(y) / 3.0::DOUBLE) + ceil((length(dst) * 2 + 29) / 3.0::DOUBLE))::BIGINT AS nb FROM e),
f AS (SELECT *, least(t // 2, na) AS fa, least(t - least(t // 2, na), nb) AS fb FROM n), r AS (SELECT *, t - fa - fb AS l, na - fa AS ra, nb - fb AS rb FROM f),
s AS (SELECT *, fa + CASE WHEN ra >= rb THEN least(l, ra) ELSE least(l - least(l, rb), ra) END AS a, fb + CASE WHEN ra >= rb THEN least(l - least(l, ra), rb) ELSE least(l, rb) END AS b FROM r)
SELECT p_partkey, 'Explain.' || chr(10) || chr(10) || 'Edge: ' || src || ' -> ' || dst || chr(10) || chr(10) || {_sql_block("src", "x", "a")} || chr(10) || chr(10) || {_sql_block("dst", "y", "b")} AS prompt FROM s""")  # fmt: skip
def edge_prompts(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.repeat(F.concat("p_name", F.lit(" ")), (k % 9 + 1).cast("int")).alias("src_text"), F.repeat("p_type", (k % 4 + 1).cast("int")).alias("dst_text"), (k % 50).cast("long").alias("t")
    )
    return context.edge_prompt(p, F.lit("Explain."), "t").select("p_partkey", "prompt")


_TURNS = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1000000 END AS t FROM conversations)
SELECT conv_id, 'Join.' || chr(10) || chr(10) || {{}}CASE WHEN t = 0 THEN '' ELSE string_agg({_sql_block("role", "text", "t")}, chr(10) ORDER BY turn) END AS prompt FROM c GROUP BY conv_id, t"""


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("conv_id") % 3 == 0, 0).otherwise(1_000_000).alias("t"))


@register(Q, SQL, _TURNS.format("'Context' || chr(10) || chr(10) || "))
def synthesizer_prompts(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("edge"), F.col("text").alias("report"), "t")
    return context.synthesizer_prompt(rows, ["conv_id"], F.lit("Join."), F.lit("Context"), "t").select("conv_id", "prompt")


@register(Q, SQL, _TURNS.format(""))
def project_prompts(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("place"), F.col("role").alias("path"), "text", "t")
    return context.project_prompt(rows, ["conv_id"], F.lit("Join."), "t").select("conv_id", "prompt")


@register(Q, SQL, f"""SELECT n_name, 'Break this dependency cycle in the ' || (CASE WHEN n_nationkey % 2 = 0 THEN 'Python' ELSE 'C#' END) || ' code:' || chr(10) || n_name || ' -> x -> ' || n_name || chr(10)
|| '- Remove one dependency of the cycle and keep the behavior.' || chr(10) || '{E.EXPLANATION_ANCHOR}' AS prompt FROM nation""")  # fmt: skip
def minimal_prompts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_name", context.minimal_prompt(F.array("n_name", F.lit("x")), F.when(F.col("n_nationkey") % 2 == 0, "python").otherwise("csharp")).alias("prompt"))


@register(Q, SQL, """WITH u AS (SELECT DISTINCT conv_id, unnest(['E' || (conv_id % 3), CASE WHEN conv_id % 4 > 0 THEN 'S' || (conv_id // 3 % 3) END]) AS variant FROM conversations)
SELECT conv_id, variant, CASE left(variant, 1) WHEN 'E' THEN 'edge' ELSE 'synthesizer' END AS agent, CASE right(variant, 1) WHEN '0' THEN 'descriptive' WHEN '1' THEN 'advisory' ELSE 'directive' END AS style FROM u WHERE variant IS NOT NULL""")
def prompt_variants(spark, sf_dir):
    """The variants that conversations' names ask of the edge and, mostly, of the synthesizer agent."""
    c = F.col("conv_id")
    own = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    named = own.select(c, F.concat(F.lit("E"), (c % 3).cast("string")).alias("edge"), F.when(c % 4 > 0, F.concat(F.lit("S"), (F.expr("conv_id div 3") % 3).cast("string"))).alias("synthesizer"))
    return context.require_variants(named, ["edge", "synthesizer"])


@register(Q, SQL, """WITH RECURSIVE c AS (SELECT conv_id, list(ceil(length(coalesce(text, '')) / 3.0::DOUBLE)::BIGINT ORDER BY turn) AS w FROM conversations GROUP BY ALL),
s AS (SELECT conv_id, w, list_transform(w, lambda x: least(300 // len(w), x)) AS g FROM c
UNION ALL SELECT conv_id, w, CASE WHEN l >= len(o) THEN list_transform(range(1, len(w) + 1), lambda i: g[i] + CASE WHEN list_contains(o, i) THEN least(w[i] - g[i], l // len(o)) ELSE 0 END)
ELSE list_transform(range(1, len(w) + 1), lambda i: g[i] + CASE WHEN list_position(o, i) <= l THEN 1 ELSE 0 END) END
FROM (SELECT *, 300 - list_sum(g) AS l, list_filter(range(1, len(w) + 1), lambda i: g[i] < w[i]) AS o FROM s) WHERE l > 0 AND len(o) > 0)
SELECT conv_id, array_to_string(arg_max(g, list_sum(g)), ',') AS allocated FROM s GROUP BY conv_id""")  # fmt: skip
def token_budget(spark, sf_dir):
    n = E.tokens_of_chars(F.length(F.coalesce("text", F.lit(""))))
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", n.alias("n")))).alias("x"))
    got = context.token_budgets(per.select("conv_id", F.transform("x", lambda x: x["n"]).alias("needs"), F.lit(300).alias("total")), "needs", "total")
    return got.select("conv_id", F.array_join(F.transform("allocated", lambda x: x.cast("string")), ",").alias("allocated"))


# Python sources -----------------------------------------------------------------------------------------------


@register(Q, SQL, """WITH b AS (SELECT p_brand, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY ALL), m AS (SELECT p_brand, p_partkey AS k, lo, hi FROM part JOIN b USING (p_brand) WHERE p_partkey % 10 <> 0),
e AS (SELECT p_brand, k, lo, unnest([lo, hi]) AS d FROM m) SELECT DISTINCT p_brand AS graph_id, 'm/' || k || '.py' AS src, 'm/' || d || '.py' AS dst FROM e WHERE d % 10 <> 0 AND (k % 3 = 2 OR (k % 3 = 0 AND d = lo))""")  # fmt: skip
def prefix_semi_join(spark, sf_dir):
    """A module graph: each part imports the first and the last of its brand, as far as its source bears that out."""
    p, k = table(spark, sf_dir, "part").select("p_brand", "p_partkey"), F.col("p_partkey")
    ends = p.groupBy("p_brand").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    named = lambda c: F.concat(F.lit("m."), F.col(c).cast("string"))
    path = F.concat(F.when(k % 10 == 0, "x/Vendors/").otherwise("m/"), k.cast("string"), F.lit(".py"))
    own = p.join(ends, "p_brand").select(F.col("p_brand").alias("graph_id"), named("p_partkey").alias("module"), path.alias("path"), F.array(named("lo"), named("hi")).alias("imports"), k, "lo")
    seen = own.where(k % 3 < 2).select("graph_id", "path", F.when(k % 3 == 0, F.concat(named("lo"), F.lit(".sub"))).otherwise("other").alias("imported"))
    return pyast.module_graph(own, seen)


@register(Q, SQL, """SELECT lang AS graph_id, i AS imported, count(*)::BIGINT AS n FROM (SELECT lang, unnest(['os', 'pkg', 'pkg.m' || (doc_id % 7)]) AS i FROM documents WHERE doc_id % 5 <> 0) GROUP BY ALL""")
def python_imports(spark, sf_dir):
    """Imports of sources made for the documents, a fifth of which can't be parsed."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("graph_id"), F.concat(F.lit("pkg/n"), k.cast("string"), F.lit(".py")).alias("path"), F.lit("").alias("import_root"), k)
    text = F.concat(
        F.lit("import os\nfrom . import m0\ndef f():\n    from .m"), (k % 7).cast("string"), F.lit(" import g\nif TYPE_CHECKING:\n    import typing_only\nelse:\n    import left_out\n"), F.when(k % 5 == 0, "def (\n").otherwise("# end\n")
    )
    return pyast.import_table(d.withColumn("text", text)).groupBy("graph_id", "imported").agg(F.count("*").alias("n"))


@register(Q, SQL, """SELECT p_partkey, n AS name FROM (SELECT p_partkey, unnest(['os', 'f' || (p_partkey % 3), 'K', 'a', 'b', 'z']) AS n FROM part WHERE p_partkey % 4 > 0)""")
def exported_names(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("import os.path\nasync def f"), (k % 3).cast("string"), F.lit("(x):\n    inner = 1\nclass K:\n    c = 1\na, b = 1, 2\nz: int = 3\nif z:\n    hidden = 1\n"), F.when(k % 4 == 0, "def (").otherwise(""))
    return pyast.export_table(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@register(Q, SQL, """WITH e AS (SELECT a.p_partkey AS s, b.p_partkey AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 OR (b.p_partkey = a.p_partkey + 2 AND b.p_partkey % 5 = 2) OR (b.p_partkey = a.p_partkey + 4 AND a.p_partkey % 2 = 0))
SELECT 'g' AS graph_id, 'src/P' || s || '.cs' AS src, 'src/P' || t || '.cs' AS dst FROM e""")  # fmt: skip
def csharp_graph(spark, sf_dir):
    """A file for each part, whose class is in one of five namespaces and names others: in view, out of view, qualified,
    aliased, and in comments and texts."""
    k = F.col("p_partkey")
    n = lambda i: (k + i).cast("string")
    space = lambda i: ((k + i) % 5).cast("string")
    lit = F.lit
    text = F.concat(
        lit("using N"), space(1), lit(";\n"), F.when(k % 2 == 0, F.concat(lit("using Q = N"), space(4), lit(".C"), n(4), lit(";\n"))).otherwise(""), lit("namespace N"), space(0), lit("\n{\n  // C"), n(7),
        lit("\n  public sealed class C"), n(0), lit("\n  {\n    System.Collections.Generic.List<C"), n(1), lit("> x; /* new C"), n(5), lit(" */ string s = \"C"), n(5), lit("\";\n    N2.C"), n(2), lit(" y; [C"), n(3),
        lit("] int q; void F() { other.C"), n(5), lit(".G(); }\n"), F.when(k % 2 == 0, "    Q z;\n").otherwise(""), lit("  }\n}\n"),
    )
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    files = parts.select(lit("g").alias("graph_id"), F.concat(lit("src/P"), n(0), lit(".cs")).alias("path"), text.alias("text"))
    return csharp.type_graph(files)

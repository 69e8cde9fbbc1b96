"""Scalar functions and predicates on names, paths, bins and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import tables
from ..sources import text as S
from ..session import spread
from .facts import BASELINE, FACTS_SQL, SELECTED, facts, register, table

Q: dict = {}
SQL: dict[str, str] = {}


@register(Q, SQL, """SELECT p_partkey, 'results/' || p_brand || '/branches/' || p_mfgr || '/ATD_identification/dependency_graph.json' AS graph, 'results/' || p_brand || '/branches/' || p_mfgr AS dir FROM
(SELECT p_partkey, p_brand, p_type AS p_mfgr FROM part)""")  # fmt: skip
def artifact_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    root = F.lit("results")
    return p.select("p_partkey", E.artifact_path(root, "p_brand", "p_type", "graph_path").alias("graph"), E.artifact_path(root, "p_brand", "p_type", "dir").alias("dir"))


#: A path for each page: its address with backslashes, as a module or a package.
_FILE = "CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') || '/__init__.py' ELSE regexp_replace(url, '^https?://', '') || '.v2.py' END"


def _files(spark, sf_dir):
    bare = F.regexp_replace("url", "^https?://", "")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(bare, F.lit("/__init__.py"))).otherwise(F.concat(bare, F.lit(".v2.py")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@register(Q, SQL, f"""WITH f AS (SELECT page_id, {_FILE} AS path FROM pages)
SELECT page_id, path AS norm, CASE WHEN ends_with(path, '/__init__.py') THEN '__init__' ELSE regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') END AS label,
replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM f""")  # fmt: skip
def path_names(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("path", F.concat(F.lit(" "), F.replace("path", F.lit("/"), F.lit("\\"))))
    return f.select("page_id", E.norm_path("path").alias("norm"), E.short_label(E.norm_path("path")).alias("label"), E.module_name("path").alias("module"))


@register(Q, SQL, """WITH l AS (SELECT c_custkey, [' python', 'CSharp', 'c#', 'Go '][1 + c_custkey % 4] AS lang, ['no_explain', 'explain_E1_S1_noaux', 'explain_graph', 'x_y_noaux'][1 + c_nationkey % 4] AS mode FROM customer),
n AS (SELECT *, CASE lang WHEN ' python' THEN 'Python' WHEN 'Go ' THEN 'Go' ELSE 'C#' END AS language,
CASE mode WHEN 'no_explain' THEN 'No explanation' WHEN 'explain_E1_S1_noaux' THEN 'E1 S1' WHEN 'explain_graph' THEN 'graph' ELSE 'x y' END AS fallback FROM l)
SELECT c_custkey, language, fallback, CASE WHEN mode = 'no_explain' THEN 'baseline' ELSE 'selected' END AS two, CASE WHEN c_custkey % 2 = 0 THEN 'given' ELSE fallback END AS many FROM n""")  # fmt: skip
def display_names(spark, sf_dir):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (F.col(k) % 4).cast("int") + 1)
    c = table(spark, sf_dir, "customer").select("c_custkey", pick([" python", "CSharp", "c#", "Go "], "c_custkey").alias("lang"), pick(["no_explain", "explain_E1_S1_noaux", "explain_graph", "x_y_noaux"], "c_nationkey").alias("mode"), F.when(F.col("c_custkey") % 2 == 0, "given").alias("label"))
    return c.select("c_custkey", E.display_language("lang").alias("language"), E.fallback_label("mode").alias("fallback"), E.display_configuration("mode", "label", ["no_explain", "m"]).alias("two"), E.display_configuration("mode", "label", ["no_explain", "m", "n"]).alias("many"))


@register(Q, SQL, f"""{FACTS_SQL}, b AS (SELECT DISTINCT cycle_id, cycle_size, cycle_centrality, baseline_scc_size, repo_dependency_graph_size AS g, cycle_external_edges AS x FROM facts), n AS (
SELECT cycle_id, CASE WHEN cycle_size BETWEEN 2 AND 3 THEN '2--3' WHEN cycle_size BETWEEN 4 AND 6 THEN '4--6' WHEN cycle_size BETWEEN 7 AND 8 THEN '7--8' END AS size_bin,
CASE WHEN cycle_centrality <= 1 THEN '<=1x average' WHEN cycle_centrality <= 2 THEN '1--2x average' ELSE '>2x average' END AS centrality,
CASE WHEN baseline_scc_size <= 10 THEN '1--10' WHEN baseline_scc_size <= 50 THEN '11--50' ELSE '>50' END AS scc,
CASE WHEN g <= 100 THEN '<=100' WHEN g <= 300 THEN '101--300' ELSE '>300' END AS repo, CASE WHEN x <= 50 THEN '<=50' WHEN x <= 100 THEN '51--100' ELSE '>100' END AS external FROM b)
SELECT *, coalesce(list_position(['2--3', '4--6', '7--8'], size_bin), 0)::BIGINT AS size_place, (list_position(['<=50', '51--100', '>100'], external) - 1)::INTEGER AS external_rank, 999 AS unknown_rank FROM n""")  # fmt: skip
def bin_labels(spark, sf_dir):
    f = facts(spark, sf_dir).select("cycle_id", "cycle_size", "cycle_centrality", "baseline_scc_size", "repo_dependency_graph_size", "cycle_external_edges").distinct()
    b = f.select(
        "cycle_id", E.size_bin("cycle_size").alias("size_bin"), E.centrality_bin("cycle_centrality").alias("centrality"), E.scc_bin("baseline_scc_size").alias("scc"), E.repo_bin("repo_dependency_graph_size").alias("repo"), E.external_bin("cycle_external_edges").alias("external")
    )
    return b.withColumns({"size_place": F.coalesce(tables.size_rank("size_bin"), F.lit(0)).cast("long"), "external_rank": E.bin_rank("external"), "unknown_rank": E.bin_rank(F.lit("none"))})


@register(Q, SQL, """WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_nationkey || '.5%' WHEN 1 THEN ' ' || c_nationkey || ' %' WHEN 2 THEN 'none' ELSE c_nationkey::VARCHAR END AS t FROM customer)
SELECT c_custkey, try_cast(trim(replace(t, '%', '')) AS DOUBLE) AS pct, CASE WHEN c_custkey % 4 = 3 THEN c_nationkey ELSE 0 END::BIGINT AS whole FROM v JOIN customer USING (c_custkey)""")  # fmt: skip
def parsed_numbers(spark, sf_dir):
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    t = F.when(k == 0, F.concat(n, F.lit(".5%"))).when(k == 1, F.concat(F.lit(" "), n, F.lit(" %"))).when(k == 2, "none").otherwise(n)
    return table(spark, sf_dir, "customer").select("c_custkey", E.parse_pct(t).alias("pct"), F.coalesce(E.to_int(t), F.lit(0).cast("long")).alias("whole"))


@register(Q, SQL, "SELECT p_partkey, 'Break ' || p_name || ' of {' || p_brand || '} twice: ' || p_name AS text, regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM part")
def filled_templates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", E.fill_template("Break {name} of {{brand}} twice: {name}", {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("text"), E.safe_filename(F.concat("p_name", F.lit(" / "), "p_type")).alias("file"))


@register(Q, SQL, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(ts, '%Y%m%dT%H%M%S-') AS stem, 24::INTEGER AS n FROM events")
def time_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    own = e.select("event_id", E.utc_text("ts").alias("utc"), E.execution_id("ts").alias("id"))
    return own.select("event_id", "utc", F.left("id", F.lit(16)).alias("stem"), F.length("id").alias("n"))


#: Imports in modules a.b.<brand>: levels 0 to 4, of targets that may be empty, half of the modules packages.
_IMPORT = """WITH i AS (SELECT p_partkey, ['a', 'b', regexp_replace(p_brand, '[^A-Za-z0-9]', '')] AS m, p_partkey % 5 AS level, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'x.y' END AS target, p_partkey % 2 = 0 AS package FROM part),
d AS (SELECT *, level - (CASE WHEN package THEN 1 ELSE 0 END) AS drop FROM i),
r AS (SELECT p_partkey, CASE WHEN drop > 3 THEN NULL ELSE array_to_string(list_filter((CASE WHEN level = 0 THEN [] ELSE m[1:greatest(3 - drop, 0)] END) || [target], lambda x: x <> ''), '.') END AS absolute,
CASE WHEN level > 3 THEN NULL ELSE array_to_string(list_filter((CASE WHEN level = 0 THEN m ELSE m[1:greatest(3 - level, 0)] END) || [target], lambda x: x <> ''), '.') END AS compat FROM d)
SELECT p_partkey, nullif(absolute, '') AS absolute, nullif(compat, '') AS compat FROM r"""


@register(Q, SQL, _IMPORT)
def import_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    args = (F.concat(F.lit("a.b."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), (F.col("p_partkey") % 5).cast("int"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("x.y"), F.col("p_partkey") % 2 == 0)
    return p.select("p_partkey", E.resolve_import(*args).alias("absolute"), E.resolve_import(*args, compat=True).alias("compat"))


#: Paths with and without vendored, built, generated and skipped parts.
_PARTS = ["src/Vendor/a.py", "lib/vendors", "vendored/x.cs", "src/obj/y.cs", "src/A.Designer.cs", "src/b.CS", "c/node_modules/d.py", "e/f.py", "bin/g.cs", "h/build/i.py", "h/builder/i.py"]


@register(Q, SQL, f"""WITH p AS (SELECT p_partkey, {_PARTS}[1 + p_partkey % 11] AS path FROM part)
SELECT p_partkey, regexp_matches(lower(path), '(^|/)vendors?(/|$)') AS vendor, regexp_matches(lower(path), '\\.cs$') AND NOT regexp_matches(lower(path), '(^|/)(bin|obj)/') AND NOT contains(lower(path), '.designer.') AS source FROM p""")  # fmt: skip
def path_predicates(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PARTS)), (F.col("p_partkey") % 11).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", E.in_vendor_dir(path).alias("vendor"), E.is_csharp_source(path).alias("source"))


@register(Q, SQL, f"""WITH p AS (SELECT p_partkey, {_PARTS}[1 + p_partkey % 11] AS path FROM part)
SELECT p_partkey, path FROM p WHERE ends_with(path, '.py') AND NOT list_has_any(string_split(path, '/'), ['node_modules', 'build', 'venv'])""")  # fmt: skip
def source_files(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PARTS)), (F.col("p_partkey") % 11).cast("int") + 1)
    return S.source_files(table(spark, sf_dir, "part").select("p_partkey", path.alias("path")))


@register(Q, SQL, """SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND value > 0 AND user_id > 0 AND event_id % 3 > 0""")
def log_positive(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return E.log_positive(e.withColumn("m", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3)), "value", "user_id", "m").select("event_id", "user_id", "value")


@register(Q, SQL, f"""{FACTS_SQL}, m AS (SELECT count(DISTINCT mode_id) AS n FROM facts WHERE mode_id IN ('{BASELINE}', '{SELECTED}')) SELECT DISTINCT mode_id FROM facts, m WHERE n = 2 AND mode_id = '{SELECTED}'""")
def selected_mode(spark, sf_dir):
    name = tables.selected_mode(facts(spark, sf_dir).where(F.col("mode_id").isin(BASELINE, SELECTED)), BASELINE)
    return spark.createDataFrame([(name,)], "mode_id string")


@register(Q, SQL, f"""{FACTS_SQL}, t AS (SELECT mode_id, language, count(*) AS runs FROM facts GROUP BY ALL)
SELECT language, mode_id, runs::BIGINT AS runs, row_number() OVER (ORDER BY language, CASE mode_id WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INTEGER AS place FROM t""")  # fmt: skip
def display_order(spark, sf_dir):
    from pyspark.sql import Window

    f = facts(spark, sf_dir).withColumn("mode_order", F.when(F.col("mode_id") == "R", 0).when(F.col("mode_id") == "N", 1).otherwise(2))
    t = f.groupBy("mode_id", "language").agg(F.count("*").alias("runs"))
    # the places of the few rows of a result table, as they are put out
    return tables.in_display_order(t, f, F.col("language")).withColumn("_i", F.monotonically_increasing_id()).select("language", "mode_id", "runs", F.row_number().over(Window.orderBy("_i")).alias("place"))


@register(Q, SQL, """WITH b AS (SELECT doc_id, length(coalesce(text, '')) AS n, length(source) * 2 + 30 AS w, (doc_id % 7) * 100 AS t FROM documents)
SELECT doc_id, greatest(1, least(ceil(n / 3.0::DOUBLE)::BIGINT + ceil(w / 3.0::DOUBLE)::BIGINT, t) * 3)::BIGINT AS chars FROM b""")  # fmt: skip
def block_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", E.block_budget("text", F.length("source") * 2 + 30, (F.col("doc_id") % 7) * 100).cast("long").alias("chars"))


@register(Q, SQL, """SELECT order_day::VARCHAR AS order_day, count(*)::BIGINT AS n FROM (SELECT o_orderdate::DATE AS order_day, o_totalprice AS s, o_custkey AS l FROM orders
WHERE date_diff('day', o_orderdate::DATE, DATE '1998-08-02') <= 365 AND o_totalprice >= 1000 AND o_custkey >= 40) GROUP BY ALL""")  # fmt: skip
def recent_enough(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("last_commit"), F.lit("1998-08-02").cast("date").alias("today"), F.col("o_totalprice").alias("stars"), F.col("o_custkey").alias("loc_nonblank"))
    return S.github_repos(o, stars=1000, loc=40, days=365).groupBy(F.col("last_commit").cast("string").alias("order_day")).agg(F.count("*").alias("n"))


@register(Q, SQL, """WITH u AS (SELECT p_partkey, 'o' || p_partkey || '/' || replace(p_brand, '#', '') AS r FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN r END AS repo FROM u""")  # fmt: skip
def github_names(spark, sf_dir):
    r = F.concat(F.lit("o"), F.col("p_partkey").cast("string"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")))
    k = F.col("p_partkey") % 4
    url = F.when(k == 0, F.concat(F.lit("https://github.com/"), r, F.lit(".git"))).when(k == 1, F.concat(F.lit("git@github.com:"), r)).when(k == 2, F.concat(F.lit(" https://github.com/"), r, F.lit("/ "))).otherwise(F.concat(F.lit("https://example.org/"), r))
    return table(spark, sf_dir, "part").select("p_partkey", E.github_repo(url).alias("repo"))


@register(Q, SQL, """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Bearer ***REDACTED***' END AS secret, c_mktsegment AS model, 'x' AS accept FROM customer""")
def logged_requests(spark, sf_dir):
    k = F.col("c_custkey")
    names = F.when(k % 2 == 0, F.when(k % 4 == 0, "AUTHORIZATION").otherwise("Authorization")).otherwise("Other")
    headers = F.create_map(names, F.concat(F.lit("Bearer "), k.cast("string")), F.lit("Accept"), F.lit("x"))
    c = table(spark, sf_dir, "customer").select(k, E.redacted_headers(headers).alias("h"), E.served_model(F.concat(F.when(k % 3 == 0, "").otherwise("openai/"), "c_mktsegment")).alias("model"))
    return c.select(k, F.coalesce(F.col("h")["AUTHORIZATION"], F.col("h")["Authorization"]).alias("secret"), "model", F.col("h")["Accept"].alias("accept"))


@register(Q, SQL, """WITH v AS (SELECT c_custkey, c_custkey % 3 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN '-0.12;0.0;0.12;;' WHEN 1 THEN '-0.16;0.0;0.16;0.0;' ELSE '-0.12;0.12;-0.12;0.12;0.0' END AS offsets FROM v""")  # fmt: skip
def marker_offsets(spark, sf_dir):
    """Rows of five values: two equal with others apart, three equal, and two pairs."""
    k = F.col("c_custkey") % 3
    row = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    values = F.when(k == 0, row(10, 20, 10.04, None, None)).when(k == 1, row(7, 7.05, 6.96, 9, None)).otherwise(row(1, 1, 2, 2, 3))
    own = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", E.marker_offsets(values).alias("o"))
    return own.select("c_custkey", F.array_join(F.transform("o", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ";").alias("offsets"))


@register(Q, SQL, "SELECT doc_id, round(doc_id % 5 + 0.25::DOUBLE * (2 * (('0x' || substr(md5('7|' || doc_id), 1, 15))::BIGINT::DOUBLE / 1152921504606846976::DOUBLE) - 1), 9) AS x FROM documents")
def jitter(spark, sf_dir):
    """Places of the documents around one of five centers."""
    from ..operators.stats import bounded_jitter

    return table(spark, sf_dir, "documents").select("doc_id", F.round(bounded_jitter(F.col("doc_id"), F.col("doc_id") % 5, 0.25, 7), 9).alias("x"))

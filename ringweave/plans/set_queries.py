"""Joins, set operations, before and after comparisons, status logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import evaluate, planning, select, status, tables
from ..operators import graph as G
from ..sources import text as S
from .facts import REACH_SQL, TRADE_SQL, register, table, trade_edges

Q: dict = {}
SQL: dict[str, str] = {}

# the graph after: trade edges whose names' lengths add up to an odd number are gone, and each nation points to the first of its region
_POST = """, post AS (SELECT graph_id, src, dst FROM edges WHERE (length(src) + length(dst)) % 4 <> 1
  UNION SELECT a.n_regionkey::VARCHAR, a.n_name, b.n_name FROM nation a JOIN (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY ALL) b USING (n_regionkey) WHERE a.n_name <> b.n_name)"""


def _post(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_name").alias("dst"))
    more = n.join(first, "n_regionkey").where("n_name <> dst").select(F.col("n_regionkey").cast("string").alias("graph_id"), F.col("n_name").alias("src"), "dst")
    return edges.where((F.length("src") + F.length("dst")) % 4 != 1).unionByName(more).distinct()


@register(Q, SQL, TRADE_SQL + _POST + "SELECT DISTINCT graph_id AS run_id FROM edges e WHERE NOT EXISTS (SELECT 1 FROM post p WHERE p.graph_id = e.graph_id AND p.src = e.src AND p.dst = e.dst)")
def cycle_eliminated(spark, sf_dir):
    own = trade_edges(spark, sf_dir).select(F.col("graph_id").alias("run_id"), F.col("graph_id").alias("post_graph"), "src", "dst")
    return evaluate.cycle_eliminated(own, _post(spark, sf_dir))


_POST_SCC = _POST + """, preach AS (SELECT graph_id, src AS a, dst AS b FROM post UNION SELECT r.graph_id, r.a, e.dst FROM preach r JOIN post e ON r.graph_id = e.graph_id AND r.b = e.src),
pmembers AS (SELECT x.graph_id, x.a AS node, least(x.a, min(x.b)) AS comp FROM preach x JOIN preach y ON x.graph_id = y.graph_id AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.graph_id, x.a)
"""


@register(Q, SQL, REACH_SQL + _POST_SCC + "SELECT DISTINCT m.graph_id AS run_id, p.comp FROM members m JOIN pmembers p USING (graph_id, node)")
def overlap_components(spark, sf_dir):
    before, after = G.strong_components(trade_edges(spark, sf_dir)), G.strong_components(_post(spark, sf_dir))
    target = before.select(F.col("graph_id").alias("run_id"), F.col("graph_id").alias("post_graph"), "node")
    return evaluate.overlapping_components(target, after).select("run_id", "comp")


@register(Q, SQL, REACH_SQL + _POST_SCC + "SELECT DISTINCT graph_id AS run_id FROM pmembers p WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.graph_id = p.graph_id AND m.node = p.node)")
def outside_target(spark, sf_dir):
    before, after = G.strong_components(trade_edges(spark, sf_dir)), G.strong_components(_post(spark, sf_dir))
    runs = after.select(F.col("graph_id").alias("run_id"), "graph_id", F.col("graph_id").alias("post_graph")).distinct()
    targets = before.select(F.col("graph_id").alias("run_id"), "node")
    return evaluate.outside_target(runs, before, after, targets)


@register(Q, SQL, REACH_SQL + """, i AS (SELECT e.graph_id, a.comp, count(*) AS m FROM edges e JOIN members a ON a.graph_id = e.graph_id AND a.node = e.src JOIN members b ON b.graph_id = e.graph_id AND b.node = e.dst AND a.comp = b.comp GROUP BY ALL)
SELECT graph_id, comp, greatest(0, m - n)::BIGINT AS redundancy FROM (SELECT graph_id, comp, count(*) AS n FROM members GROUP BY ALL) JOIN i USING (graph_id, comp)""")  # fmt: skip
def component_redundancy(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    return evaluate.component_redundancy(edges, G.strong_components(edges))


def _half(spark, sf_dir, first: bool):
    e = table(spark, sf_dir, "events").where((F.col("event_id") % 2 == 0) if first else (F.col("event_id") % 2 == 1))
    n = lambda t: E.count_if(F.col("event_type") == t)
    c = e.groupBy("user_id").agg(F.count("*").alias("tests"), n("error").alias("failures"), n("signup").alias("errors"), n("view").alias("skipped"))
    return c.withColumn("passed", F.greatest(F.lit(0), F.expr("tests - failures - errors - skipped")))


_HALF = """SELECT user_id, count(*) FILTER (event_type = 'error') AS f, count(*) FILTER (event_type = 'signup') AS e, count(*) FILTER (event_type = 'view') AS s,
greatest(0, count(*) FILTER (event_type NOT IN ('error', 'signup', 'view'))) AS p FROM events WHERE event_id % 2 = {0} GROUP BY user_id"""


@register(Q, SQL, f"""WITH b AS ({_HALF.format(0)}), a AS ({_HALF.format(1)})
SELECT user_id, coalesce(a.f <= b.f AND a.e <= b.e AND a.s <= b.s AND a.p >= b.p, FALSE) AS preserved FROM b FULL JOIN a USING (user_id)""")  # fmt: skip
def behavior_preserved(spark, sf_dir):
    b, a = _half(spark, sf_dir, True).alias("b"), _half(spark, sf_dir, False).alias("a")
    return b.join(a, "user_id", "full").select("user_id", evaluate.behavior_preserved("b", "a").alias("preserved"))


@register(Q, SQL, """WITH m AS (SELECT DISTINCT c_mktsegment AS mode_id FROM customer), c AS (SELECT n_name AS repo, 'scc_0_cycle_' || n_nationkey AS cycle_id, n_regionkey FROM nation)
SELECT mode_id, experiment_id, repo, cycle_id, r_name AS language, regexp_replace('atd-' || experiment_id || '-' || mode_id || '-' || cycle_id, '[^A-Za-z0-9._/-]+', '-', 'g') AS branch_name
FROM m CROSS JOIN (SELECT unnest(['e1', 'e2']) AS experiment_id) CROSS JOIN c JOIN region ON n_regionkey = r_regionkey""")  # fmt: skip
def planned_runs(spark, sf_dir):
    modes = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("mode_id")).distinct()
    modes = modes.select("mode_id", F.col("mode_id").alias("mode_label"), F.lit(0).alias("mode_order"), F.array(F.lit("e1"), F.lit("e2")).alias("experiments"))
    n = table(spark, sf_dir, "nation")
    cycles = n.select(F.col("n_name").alias("repo"), F.lit("main").alias("base_branch"), F.concat(F.lit("scc_0_cycle_"), F.col("n_nationkey").cast("string")).alias("cycle_id"))
    repos = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("repo"), F.lit("main").alias("base_branch"), F.lit("src").alias("entry"), F.col("r_name").alias("language"))
    return planning.planned_runs(modes, cycles, repos, "results").select("mode_id", "experiment_id", "repo", "cycle_id", "language", "branch_name")


@register(Q, SQL, TRADE_SQL + "SELECT graph_id, node FROM (SELECT n_regionkey::VARCHAR AS graph_id, n_name AS node FROM nation UNION SELECT graph_id, src FROM edges UNION SELECT graph_id, dst FROM edges)")
def node_union(spark, sf_dir):
    declared = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("graph_id"), F.col("n_name").alias("node"))
    return G.graph_nodes(trade_edges(spark, sf_dir), declared)


@register(Q, SQL, TRADE_SQL + _POST + "SELECT graph_id, src, dst FROM edges EXCEPT SELECT graph_id, src, dst FROM post")
def edge_except(spark, sf_dir):
    return G.lost_edges(trade_edges(spark, sf_dir), _post(spark, sf_dir))


@register(Q, SQL, "SELECT user_id, arg_max(event_type, (ts, event_id)) AS outcome, max((ts, event_id))[2] AS last_event FROM events GROUP BY user_id")
def resume_latest_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "outcome").withColumn("last_event", F.col("event_id"))
    return status.latest(e, ["user_id"], ["ts", "event_id"], ["outcome", "last_event"])


@register(Q, SQL, "SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS o FROM events WHERE event_id % 2 = 0 GROUP BY user_id) RIGHT JOIN (SELECT DISTINCT user_id FROM events) USING (user_id) WHERE o IS DISTINCT FROM 'purchase'")
def resume_to_run(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select("user_id", F.when(F.col("event_id") % 2 == 0, "explain").otherwise("metrics").alias("phase"), F.struct("ts", "event_id").alias("ts"), F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type")).alias("outcome"))
    return status.to_run(e.select("user_id").distinct(), log, ["user_id"], "explain")


@register(Q, SQL, "SELECT user_id, event_id FROM (SELECT *, min(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS b FROM events) WHERE event_id > b")
def fail_fast_check(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "blocked").otherwise("ok").alias("outcome"))
    return status.after_block(e, "event_id", ["user_id"]).select("user_id", "event_id")


@register(Q, SQL, """SELECT bin, language, repo, size::INTEGER AS size, n FROM (SELECT CASE WHEN l BETWEEN 2 AND 3 THEN '2-3' WHEN l BETWEEN 4 AND 6 THEN '4-6' ELSE '7-8' END AS bin, language, repo, l AS size, count(*)::BIGINT AS n
FROM (SELECT 2 + c_custkey % 7 AS l, c_mktsegment AS language, n_name AS repo FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY GROUPING SETS ((1), (language), (repo), (repo, 1), (repo, size)))""".replace("GROUPING SETS ((1), (language), (repo), (repo, 1), (repo, size))", "GROUPING SETS ((bin), (language), (repo), (repo, bin), (repo, size))"))  # fmt: skip
def availability_counters(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("repo"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") % 7 + 2).cast("int").alias("size"), F.col("c_mktsegment").alias("language"), "repo")
    return select.counters(c.withColumn("bin", E.size_bin("size", E.parse_bins("2-3,4-6,7-8")))).drop("gid")


@register(Q, SQL, "SELECT o_custkey, min(o_orderkey)::BIGINT AS o_orderkey FROM orders GROUP BY o_custkey")
def first_appearance(spark, sf_dir):
    return S.first_seen(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@register(Q, SQL, "SELECT 'dev' AS split, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'eval', doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'")
def split_union(spark, sf_dir):
    d, english = table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang").eqNullSafe("en")
    return tables.union_of_splits({"dev": d.where(english), "eval": d.where(~english)}).select("split", "doc_id")


@register(Q, SQL, "SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_units(spark, sf_dir):
    units = table(spark, sf_dir, "customer").where("c_acctbal >= 1000").select("c_custkey")
    return status.missing(units, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])

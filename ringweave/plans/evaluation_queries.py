"""Evaluation of runs, documents of graphs, cycles in their surroundings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import evaluate, select, tables
from ..operators import graph as G
from ..sources import graphs, sinks
from .facts import FACTS_SQL, REACH_SQL, TRADE_SQL, facts, register, table, trade_edges
from .graph_queries import _CYCLES, _METRICS, _rank_sql
from .set_queries import _POST_SCC, _post

Q: dict = {}
SQL: dict[str, str] = {}

_POST_METRICS = """, pinside AS (SELECT e.graph_id, a.comp, e.src, e.dst FROM post e JOIN pmembers a ON a.graph_id = e.graph_id AND a.node = e.src JOIN pmembers b ON b.graph_id = e.graph_id AND b.node = e.dst AND b.comp = a.comp
), pm AS (SELECT graph_id, comp, n, greatest(0, m - n) AS redundancy FROM (SELECT graph_id, comp, count(*) AS n FROM pmembers GROUP BY ALL) JOIN (SELECT graph_id, comp, count(*) AS m FROM pinside GROUP BY ALL) USING (graph_id, comp))"""


def _sccs(edges):
    return G.scc_metrics(edges, G.strong_components(edges)).withColumn("self_loop", F.lit(False))


@register(Q, SQL, REACH_SQL + _METRICS + "SELECT graph_id, scc_id, sum(length(node) * 7)::BIGINT AS total_loc, round_even(sum(length(node) * 7) / min(size)::DOUBLE, 2) AS avg_loc_per_node FROM members JOIN metrics USING (graph_id, comp) GROUP BY ALL")
def scc_loc(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    loc = G.graph_nodes(edges).withColumn("loc", F.length("node") * 7)
    return G.scc_metrics(edges, G.strong_components(edges), loc).select("graph_id", "scc_id", "total_loc", "avg_loc_per_node")


@register(Q, SQL, REACH_SQL + _METRICS + "SELECT graph_id, sum(redundancy)::BIGINT AS redundancy FROM metrics GROUP BY ALL")
def report_redundancy(spark, sf_dir):
    return evaluate.report_redundancy(_sccs(trade_edges(spark, sf_dir)))


@register(Q, SQL, REACH_SQL + _METRICS + _POST_SCC + _POST_METRICS + """, runs AS (SELECT graph_id || '/' || scc_id AS run_id, * FROM metrics),
gone AS (SELECT DISTINCT i.graph_id, i.comp FROM inside i WHERE NOT EXISTS (SELECT 1 FROM post p WHERE p.graph_id = i.graph_id AND p.src = i.src AND p.dst = i.dst)),
near AS (SELECT DISTINCT m.graph_id, m.comp, p.comp AS pcomp FROM members m JOIN pmembers p USING (graph_id, node)),
local AS (SELECT n.graph_id, n.comp, count(*) AS comps, sum(pm.redundancy) AS post_local FROM near n JOIN pm ON pm.graph_id = n.graph_id AND pm.comp = n.pcomp GROUP BY ALL),
outside AS (SELECT DISTINCT graph_id FROM pmembers p WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.graph_id = p.graph_id AND m.node = p.node)),
red AS (SELECT graph_id, sum(redundancy) AS red FROM metrics GROUP BY ALL), pred AS (SELECT graph_id, sum(redundancy) AS pred FROM pm GROUP BY ALL),
x AS (SELECT run_id, r.graph_id <> '3' AS normal, redundancy AS base_local, coalesce(post_local, 0) AS post_local, coalesce(comps, 0) AS comps, g.comp IS NOT NULL AS gone, o.graph_id IS NOT NULL AS outside, red, coalesce(pred, 0) AS pred
FROM runs r LEFT JOIN gone g USING (graph_id, comp) LEFT JOIN local USING (graph_id, comp) LEFT JOIN outside o USING (graph_id) LEFT JOIN red USING (graph_id) LEFT JOIN pred USING (graph_id))
SELECT run_id, TRUE AS structurally_evaluable, normal AND gone AS cycle_eliminated_raw, normal AND comps <> 1 AND post_local < base_local AS structural_improvement_raw, normal AND comps = 1 AND post_local < base_local AS weakening_improvement_raw,
normal AND (pred > red OR outside) AS global_structural_regression_raw, normal AND outside AS global_regression_outside_target_raw, base_local::BIGINT AS baseline_local_redundancy,
(CASE WHEN normal THEN post_local ELSE base_local END)::BIGINT AS post_local_redundancy, red::BIGINT AS baseline_global_redundancy, (CASE WHEN normal THEN pred ELSE red END)::BIGINT AS post_global_redundancy FROM x
UNION ALL SELECT 'odd/' || graph_id, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, 0, 0, 0, 0 FROM red""")  # fmt: skip
def structural_metrics(spark, sf_dir):
    """A run for each component of the trade graphs; one region has no graph after, and odd runs lack a report."""
    before, after = trade_edges(spark, sf_dir), _post(spark, sf_dir)
    base, post = _sccs(before), _sccs(after)
    inside = G.induced_edges(before, G.strong_components(before)).join(base.select("graph_id", "comp", "scc_id"), ["graph_id", "comp"])
    catalog = inside.groupBy("graph_id", F.concat("scc_id", F.lit("_cycle_0")).alias("cycle_id")).agg(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("edges"))
    there = F.col("graph_id") != "3"
    flags = lambda report, after: {"no_change": ~there, "has_graph": F.lit(True), "has_report": report, "has_catalog": F.lit(True), "has_post_report": after, "has_post_graph": after}
    runs = base.select(F.concat_ws("/", "graph_id", "scc_id").alias("run_id"), "graph_id", F.col("graph_id").alias("post_graph"), F.concat("scc_id", F.lit("_cycle_0")).alias("cycle_id")).withColumns(flags(F.lit(True), there))
    odd = base.select(F.concat(F.lit("odd/"), "graph_id").alias("run_id"), "graph_id", F.col("graph_id").alias("post_graph"), F.lit("scc_0_cycle_0").alias("cycle_id")).distinct().withColumns(flags(F.lit(False), there))
    return evaluate.structural_metrics(runs.unionByName(odd), base, catalog, after, post)


_RUNS = """SELECT l_orderkey * 10 + l_linenumber AS run_id, l_returnflag AS mode_id, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS mode_order, 'r' || (l_suppkey % 7) AS repo, 'scc_0_cycle_' || l_suppkey AS cycle_id,
'e' || l_linenumber AS experiment_id, (l_tax < 0.07::DOUBLE)::INTEGER AS evaluable, (l_quantity > 20)::INTEGER AS kept, (l_discount < 0.06::DOUBLE)::INTEGER AS gone, (l_linenumber % 4 = 0)::INTEGER AS parted, (l_linenumber % 4 IN (1, 2))::INTEGER AS weaker,
(l_partkey % 11 = 0)::INTEGER AS worse FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_suppkey) AS l_suppkey, min(l_tax) AS l_tax, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount,
min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)"""


@register(Q, SQL, f"""WITH x AS ({_RUNS}), o AS (SELECT *, (kept = 1 AND gone = 1)::INTEGER AS cycle_broken, (kept = 1 AND evaluable = 1 AND (parted = 1 OR weaker = 1))::INTEGER AS local_improvement, (evaluable <> 1)::INTEGER AS other_incomplete FROM x)
SELECT run_id, mode_id, repo, cycle_id, experiment_id, cycle_broken, local_improvement, (cycle_broken = 1 AND local_improvement = 1 AND worse <> 1)::INTEGER AS success, other_incomplete FROM o""")  # fmt: skip
def all_runs(spark, sf_dir):
    """The fact table of planned and evaluated runs, one for each line item."""
    li, c = table(spark, sf_dir, "lineitem"), F.col
    li = li.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(x).alias(x) for x in ("l_returnflag", "l_suppkey", "l_tax", "l_quantity", "l_discount", "l_partkey")])
    run = (c("l_orderkey") * 10 + c("l_linenumber")).alias("run_id")
    planned = li.select(
        run, c("l_returnflag").alias("mode_id"), F.when(c("l_returnflag") == "R", 0).when(c("l_returnflag") == "A", 1).otherwise(2).alias("mode_order"), F.concat(F.lit("r"), (c("l_suppkey") % 7).cast("string")).alias("repo"),
        F.concat(F.lit("scc_0_cycle_"), c("l_suppkey").cast("string")).alias("cycle_id"), F.concat(F.lit("e"), c("l_linenumber").cast("string")).alias("experiment_id"),
    )
    bit = lambda x, name: x.cast("int").alias(name)
    evaluated = li.select(
        run, bit(c("l_tax") < 0.07, "structurally_evaluable"), bit(c("l_quantity") > 20, "behavior_preserved"), bit(c("l_discount") < 0.06, "cycle_eliminated_raw"), bit(c("l_linenumber") % 4 == 0, "structural_improvement_raw"),
        bit((c("l_linenumber") % 4).isin(1, 2), "weakening_improvement_raw"), bit(c("l_partkey") % 11 == 0, "global_structural_regression_raw"),
    )
    return evaluate.all_runs(planned, evaluated).select("run_id", "mode_id", "repo", "cycle_id", "experiment_id", "cycle_broken", "local_improvement", "success", "other_incomplete")


@register(Q, SQL, f"""{FACTS_SQL} SELECT repo, 'e' AS experiment, cycle_id AS cycle, mode_id AS mode, mode_label AS configuration, sum(success)::BIGINT AS success, sum(global_structural_regression_raw)::BIGINT AS "global regression",
sum(other_incomplete)::BIGINT AS incomplete, count(*)::BIGINT AS n FROM facts GROUP BY ALL""")  # fmt: skip
def run_outcomes(spark, sf_dir):
    f = facts(spark, sf_dir).withColumns({"experiment_id": F.lit("e"), "no_change": F.lit(0), "openhands_outcome": F.lit("")})
    return sinks.run_outcomes(f).groupBy("repo", "experiment", "cycle", "mode", "configuration").agg(*[F.sum(c).alias(c) for c in ("success", "global regression", "incomplete")], F.count("*").alias("n"))


_DIFFICULTY = _rank_sql(50, REACH_SQL + _METRICS, """, ext AS (SELECT c.graph_id, c.comp, count(*) AS x FROM comps c JOIN edges e ON e.graph_id = c.graph_id AND (list_contains(c.nodes, e.src) <> list_contains(c.nodes, e.dst)) GROUP BY ALL),
central AS (SELECT m.graph_id, m.comp, avg(r) * min(n) AS c FROM members m JOIN {last} USING (graph_id, node) GROUP BY ALL)
SELECT t.graph_id, scc_id || '_cycle_0' AS cycle_id, round(c, 6) AS cycle_centrality, t.size::BIGINT AS baseline_scc_size, s.n::BIGINT AS repo_dependency_graph_size, coalesce(x, 0)::BIGINT AS cycle_external_edges
FROM metrics t JOIN central USING (graph_id, comp) JOIN size s ON s.graph_id = t.graph_id LEFT JOIN ext ON ext.graph_id = t.graph_id AND ext.comp = t.comp""")  # fmt: skip


@register(Q, SQL, _DIFFICULTY)
def cycle_difficulty(spark, sf_dir):
    """The components of the trade graphs as cycles, each given twice."""
    edges = trade_edges(spark, sf_dir)
    sccs = _sccs(edges)
    cycles = sccs.select("graph_id", F.concat("scc_id", F.lit("_cycle_0")).alias("cycle_id"), "nodes")
    got = evaluate.difficulty_metrics(cycles.unionByName(cycles), edges, G.graph_nodes(edges), sccs)
    return got.select("graph_id", "cycle_id", F.round("cycle_centrality", 6).alias("cycle_centrality"), "baseline_scc_size", "repo_dependency_graph_size", "cycle_external_edges")


@register(Q, SQL, TRADE_SQL + """, n AS (SELECT graph_id, src AS node FROM edges UNION SELECT graph_id, dst FROM edges)
SELECT graph_id, 'edge' AS what, src, dst FROM edges UNION ALL SELECT graph_id, 'node', node, '/' || node FROM n""")  # fmt: skip
def graph_documents(spark, sf_dir):
    """Graph documents are made and read back."""
    edges = trade_edges(spark, sf_dir)
    nodes = G.graph_nodes(edges).withColumn("abs_path", F.concat(F.lit("/"), "node"))
    info = edges.select("graph_id").distinct().withColumns({"language": F.lit("python"), "repo_root": F.lit("/r"), "entry": F.lit("src")})
    docs = sinks.graph_documents(nodes, edges, info).withColumn("doc", F.from_json("doc", graphs.GRAPH))
    n = docs.where("doc.schema_version = 1 and doc.language = 'python' and doc.entry = 'src'").select("graph_id", F.explode("doc.nodes").alias("n")).where("n.kind = 'file'")
    read = graphs.edges_of(docs).select("graph_id", F.lit("edge").alias("what"), "src", "dst")
    return read.unionByName(n.select("graph_id", F.lit("node").alias("what"), F.col("n.id").alias("src"), F.col("n.abs_path").alias("dst")))


@register(Q, SQL, _rank_sql(50, REACH_SQL + _METRICS, """SELECT m.graph_id, scc_id, size::BIGINT AS size, edge_count::BIGINT AS edge_count, array_to_string(list(DISTINCT node ORDER BY node), ',') AS nodes, round(sum(r), 6) AS ranks,
(SELECT count(*) FROM metrics k WHERE k.graph_id = m.graph_id)::BIGINT AS scc_count FROM members m JOIN metrics USING (graph_id, comp) JOIN {last} USING (graph_id, node) GROUP BY ALL"""))  # fmt: skip
def report_documents(spark, sf_dir):
    """Component reports are made, and components and ranks read from them."""
    edges = trade_edges(spark, sf_dir)
    members = G.strong_components(edges)
    nodes, sccs = G.graph_nodes(edges), G.scc_metrics(edges, members)
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("node_count")).join(edges.groupBy("graph_id").agg(F.count("*").alias("edge_count")), "graph_id")
    made = sinks.report_documents(sccs, G.induced_edges(edges, members), G.scc_global(sccs), G.pagerank(edges, nodes), size)
    docs = made.withColumn("doc", F.from_json("doc", graphs.SCC_REPORT.replace("sccs:", "global_metrics:struct<scc_count:bigint>,sccs:")))
    s = graphs.sccs_of(docs).withColumn("node", F.explode("nodes"))
    got = s.join(graphs.ranks_of(docs), ["graph_id", "node"]).groupBy("graph_id", "scc_id", "size", "edge_count").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("nodes"), F.round(F.sum("rank"), 6).alias("ranks"))
    return got.join(docs.select("graph_id", "doc.global_metrics.scc_count"), "graph_id")


@register(Q, SQL, _CYCLES + _METRICS + """SELECT c.graph_id, count(*)::BIGINT AS cycles, (SELECT count(*) FROM metrics k WHERE k.graph_id = c.graph_id)::BIGINT AS sccs, sum(len(nodes))::BIGINT AS length, min(array_to_string(nodes, ',')) AS first FROM cycles c GROUP BY ALL""")
def catalog_documents(spark, sf_dir):
    """Catalogs of all cycles are made, and the cycles read from them."""
    edges = trade_edges(spark, sf_dir)
    members = G.strong_components(edges)
    from pyspark.sql import Window

    cycles = G.cycle_ranks(G.enumerate_cycles(edges, members), G.pagerank(edges, G.graph_nodes(edges)))
    placed = cycles.withColumn("place", F.row_number().over(Window.partitionBy("graph_id", "comp").orderBy("nodes")) - 1)
    sccs = G.scc_metrics(edges, members)
    docs = sinks.catalog_documents(G.cycle_catalog(placed, sccs), sccs).withColumn("doc", F.from_json("doc", graphs.CATALOG.replace("sccs:", "summary:struct<scc_count:bigint>,sccs:")))
    c = graphs.cycles_of(docs).where(F.col("cycle_id").startswith(F.concat("scc_id", F.lit("_cycle_"))))
    read = c.groupBy("graph_id").agg(F.count("*").alias("cycles"), F.sum("length").cast("long").alias("length"), F.min(F.array_join("nodes", ",")).alias("first"))
    return read.join(docs.select("graph_id", F.col("doc.summary.scc_count").alias("sccs")), "graph_id")


@register(Q, SQL, REACH_SQL + """, n AS (SELECT graph_id, src AS node FROM edges UNION SELECT graph_id, dst FROM edges), sel AS (SELECT graph_id, min(comp) AS comp FROM members GROUP BY ALL),
k AS (SELECT n.graph_id, n.node, CASE WHEN s.comp IS NOT NULL THEN 'selected' WHEN m.comp IS NOT NULL THEN 'scc' ELSE 'graph' END AS kind FROM n LEFT JOIN members m USING (graph_id, node) LEFT JOIN sel s ON s.graph_id = m.graph_id AND s.comp = m.comp)
SELECT graph_id, 'node' AS what, kind, count(*)::BIGINT AS n FROM k GROUP BY ALL
UNION ALL SELECT e.graph_id, 'edge', CASE WHEN a.comp IS NOT NULL AND a.comp = b.comp THEN 'scc' ELSE 'graph' END, count(*) FROM edges e LEFT JOIN members a ON a.graph_id = e.graph_id AND a.node = e.src LEFT JOIN members b ON b.graph_id = e.graph_id AND b.node = e.dst GROUP BY ALL""")  # fmt: skip
def classified(spark, sf_dir):
    """Nodes and edges by what they are in; the first component of each graph is selected, as a ring that has no edge of its own."""
    edges = trade_edges(spark, sf_dir)
    members = G.strong_components(edges)
    first = members.groupBy("graph_id").agg(F.min("comp").alias("comp"))
    ring = members.join(first, ["graph_id", "comp"]).groupBy("graph_id").agg(F.collect_list("node").alias("nodes")).select("graph_id", F.lit("c").alias("cycle_id"), "nodes")
    n, _ = G.classify(G.graph_nodes(edges), edges, members, ring)
    _, e = G.classify(G.graph_nodes(edges), edges, members, ring.select("graph_id", "cycle_id", F.array(F.lit("none")).alias("nodes")))
    count = lambda df, what: df.groupBy("graph_id", "kind").agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return count(n, "node").unionByName(count(e, "edge")).select("graph_id", "what", "kind", "n")


@register(Q, SQL, REACH_SQL + """, t AS (SELECT m.comp AS cycle_id, 'out' AS direction, e.dst AS node, count(*) AS n FROM edges e JOIN members m ON m.graph_id = e.graph_id AND m.node = e.src
LEFT JOIN members o ON o.graph_id = e.graph_id AND o.node = e.dst AND o.comp = m.comp WHERE o.node IS NULL GROUP BY ALL
UNION ALL SELECT m.comp, 'in', e.src, count(*) FROM edges e JOIN members m ON m.graph_id = e.graph_id AND m.node = e.dst LEFT JOIN members o ON o.graph_id = e.graph_id AND o.node = e.src AND o.comp = m.comp WHERE o.node IS NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY cycle_id, direction ORDER BY n DESC, node) AS place FROM t) SELECT cycle_id, direction, node, n::BIGINT AS n, place::INTEGER AS place FROM p WHERE place <= 2""")  # fmt: skip
def external_top(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    members = G.strong_components(edges).select(F.col("comp").alias("cycle_id"), "node")
    return tables.external_top(edges.select("src", "dst"), members, 2)


@register(Q, SQL, _CYCLES + """, u AS (SELECT graph_id, unnest(nodes) AS node FROM cycles), n AS (SELECT graph_id, node, count(*) AS n FROM u GROUP BY ALL)
SELECT graph_id AS repo, max(n)::BIGINT AS max_use, count(*) FILTER (n >= 2)::BIGINT AS reused, count(*)::BIGINT AS distinct_nodes FROM n GROUP BY ALL""")  # fmt: skip
def overlap_summary(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    return select.overlap_summary(G.enumerate_cycles(edges, G.strong_components(edges)).withColumnRenamed("graph_id", "repo"))


@register(Q, SQL, _CYCLES + "SELECT graph_id, array_to_string(nodes || nodes[:1], ' -> ') AS chain, array_to_string(nodes, ',') AS nodes FROM cycles")
def cycle_chains(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    return G.enumerate_cycles(edges, G.strong_components(edges)).select("graph_id", E.cycle_chain("nodes").alias("chain"), F.array_join("nodes", ",").alias("nodes"))


@register(Q, SQL, TRADE_SQL + """, f AS (SELECT graph_id, left(src, 1) || '/' || src AS src, left(dst, 1) || '/' || dst AS dst FROM edges), c AS (SELECT graph_id, min(src) AS a, max(src) AS b FROM f GROUP BY ALL), m AS (SELECT graph_id, unnest([a, b]) AS node FROM c),
o AS (SELECT DISTINCT f.graph_id, f.src AS node, 'out' AS direction, f.dst AS path FROM f JOIN m ON m.graph_id = f.graph_id AND m.node = f.src UNION ALL SELECT DISTINCT f.graph_id, f.dst, 'in', f.src FROM f JOIN m ON m.graph_id = f.graph_id AND m.node = f.dst),
x AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.graph_id = o.graph_id AND m.node = o.path)), n AS (SELECT graph_id, node, direction, left(path, 1) AS folder, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY graph_id, node, direction ORDER BY n DESC, folder) AS place, count(*) OVER (PARTITION BY graph_id, node, direction) AS all_of FROM n)
SELECT graph_id, node, direction, t.total::BIGINT AS total, string_agg(folder || ' (' || n || ')', ', ' ORDER BY place) AS folders, greatest(max(all_of) - 2, 0)::BIGINT AS omitted_folders, least(t.total, 3)::BIGINT AS samples, greatest(t.total - 3, 0)::BIGINT AS omitted
FROM p JOIN (SELECT graph_id, node, direction, count(*) AS total FROM x GROUP BY ALL) t USING (graph_id, node, direction) WHERE place <= 2 GROUP BY ALL""")  # fmt: skip
def external_connections(spark, sf_dir):
    """What lies around two nations of each region, with their first letters as folders."""
    from ..operators import context

    folder = lambda c: F.concat(F.left(c, F.lit(1)), F.lit("/"), c)
    edges = trade_edges(spark, sf_dir).select("graph_id", folder("src").alias("src"), folder("dst").alias("dst"))
    cycles = edges.groupBy("graph_id").agg(F.array(F.min("src"), F.max("src")).alias("nodes")).select("graph_id", F.lit("c").alias("cycle_id"), "nodes", F.lit("").alias("src_root"))
    got = context.external_connections(cycles, edges, 1, 2, 3)
    return got.select("graph_id", "node", "direction", "total", "folders", F.col("omitted_folders").cast("long").alias("omitted_folders"), F.size("samples").cast("long").alias("samples"), F.col("omitted").cast("long").alias("omitted"))

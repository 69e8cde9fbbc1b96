"""Graph operators over the trade graph and the users' graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import context, select
from ..operators import graph as G
from .facts import REACH_SQL, TRADE_SQL, register, trade_edges, user_edges

Q: dict = {}
SQL: dict[str, str] = {}

_METRICS = """, inside AS (
  SELECT e.graph_id, a.comp, e.src, e.dst FROM edges e JOIN members a ON a.graph_id = e.graph_id AND a.node = e.src
  JOIN members b ON b.graph_id = e.graph_id AND b.node = e.dst AND b.comp = a.comp
), comps AS (SELECT graph_id, comp, count(*) AS size, list(node ORDER BY node) AS nodes FROM members GROUP BY ALL
), m AS (SELECT graph_id, comp, count(*) AS m, count(DISTINCT (least(src, dst), greatest(src, dst))) AS mu FROM inside GROUP BY ALL
), metrics AS (
  SELECT graph_id, 'scc_' || (row_number() OVER (PARTITION BY graph_id ORDER BY size DESC, nodes DESC) - 1) AS scc_id, comp, size, m AS edge_count,
    round_even(m / (size * (size - 1))::DOUBLE, 6) AS density_directed, greatest(0, mu - (size - 1)) AS edge_surplus_lb, greatest(0, m - size) AS redundancy
  FROM comps JOIN m USING (graph_id, comp)
)"""


def _metrics(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    return edges, G.scc_metrics(edges, G.strong_components(edges))


@register(Q, SQL, REACH_SQL + "SELECT graph_id, node, comp FROM members")
def scc(spark, sf_dir):
    return G.strong_components(trade_edges(spark, sf_dir))


@register(Q, SQL, REACH_SQL + _METRICS + "SELECT graph_id, scc_id, comp, size::BIGINT AS size, edge_count::BIGINT AS edge_count, density_directed, edge_surplus_lb::BIGINT AS edge_surplus_lb, redundancy::BIGINT AS redundancy FROM metrics")
def scc_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)[1].select("graph_id", "scc_id", "comp", "size", "edge_count", "density_directed", "edge_surplus_lb", "redundancy")


@register(Q, SQL, REACH_SQL + _METRICS + """SELECT graph_id, count(*)::BIGINT AS scc_count, sum(size)::BIGINT AS total_nodes, sum(edge_count)::BIGINT AS total_edges, max(size)::BIGINT AS max_scc_size,
round_even(avg(size), 3) AS avg_scc_size, sum(edge_surplus_lb)::BIGINT AS cycle_pressure_lb, sum(redundancy)::BIGINT AS redundancy FROM metrics GROUP BY graph_id""")  # fmt: skip
def scc_global(spark, sf_dir):
    return G.scc_global(_metrics(spark, sf_dir)[1])


_USERS = """WITH RECURSIVE edges AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS dst
FROM events WHERE event_type = 'purchase') WHERE dst IS NOT NULL AND src <> dst)"""


@register(Q, SQL, _USERS + """, reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src),
members AS (SELECT x.a AS node, least(x.a, min(x.b)) AS comp FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
SELECT comp, count(*)::BIGINT AS size FROM members GROUP BY comp""")  # fmt: skip
def scc_users(spark, sf_dir):
    return G.strong_components(user_edges(spark, sf_dir)).groupBy("comp").agg(F.count("*").alias("size"))


def _rank_sql(rounds: int, edges: str, end: str) -> str:
    steps = ["nodes AS (SELECT graph_id, src AS node FROM edges UNION SELECT graph_id, dst FROM edges)", "size AS (SELECT graph_id, count(*)::DOUBLE AS n FROM nodes GROUP BY ALL)",
             "outs AS (SELECT graph_id, src AS node, count(*) AS o FROM edges GROUP BY ALL)", "r0 AS MATERIALIZED (SELECT graph_id, node, n, o, 1 / n AS r FROM nodes JOIN size USING (graph_id) LEFT JOIN outs USING (graph_id, node))"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT v.graph_id, v.node, v.n, v.o, (1 - 0.85::DOUBLE) / v.n + 0.85::DOUBLE * coalesce(k.s, 0) / v.n + 0.85::DOUBLE * coalesce(g.g, 0) AS r FROM r{i} v
LEFT JOIN (SELECT graph_id, sum(r) AS s FROM r{i} WHERE o IS NULL GROUP BY ALL) k USING (graph_id)
LEFT JOIN (SELECT e.graph_id, e.dst AS node, sum(u.r / u.o) AS g FROM edges e JOIN r{i} u ON u.graph_id = e.graph_id AND u.node = e.src GROUP BY ALL) g ON g.graph_id = v.graph_id AND g.node = v.node)""")
    return f"{edges}, {', '.join(steps)} {end.format(last=f'r{rounds}')}"


@register(Q, SQL, _rank_sql(50, TRADE_SQL, "SELECT graph_id, node, round(r, 9) AS rank FROM {last}"))
def pagerank_fixed(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    return G.pagerank(edges, G.graph_nodes(edges)).select("graph_id", "node", F.round("rank", 9).alias("rank"))


@register(Q, SQL)
def pagerank_converged(spark, sf_dir):
    edges = user_edges(spark, sf_dir)
    return G.pagerank(edges, G.graph_nodes(edges), iterations=100, tol=1e-6, no_edges="zero").select("graph_id", "node", F.round("rank", 6).alias("rank"))


_CYCLES = REACH_SQL + """, paths AS (
  SELECT graph_id, src AS start, dst AS cur, [src, dst] AS nodes FROM edges WHERE dst > src
  UNION ALL SELECT p.graph_id, p.start, e.dst, list_append(p.nodes, e.dst) FROM paths p JOIN edges e ON e.graph_id = p.graph_id AND e.src = p.cur
  WHERE e.dst > p.start AND NOT list_contains(p.nodes, e.dst) AND len(p.nodes) < 8
), cycles AS (SELECT p.graph_id, p.nodes FROM paths p JOIN edges e ON e.graph_id = p.graph_id AND e.src = p.cur AND e.dst = p.start
)"""


def _cycles(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    return edges, G.enumerate_cycles(edges, G.strong_components(edges))


def _chained(spark, sf_dir):
    edges, c = _cycles(spark, sf_dir)
    return edges, c.select("graph_id", E.cycle_chain("nodes").alias("cycle_id"), "nodes")


@register(Q, SQL, _CYCLES + "SELECT graph_id, len(nodes)::INTEGER AS length, array_to_string(nodes, ',') AS nodes FROM cycles")
def cycle_enumeration(spark, sf_dir):
    return _cycles(spark, sf_dir)[1].select("graph_id", F.size("nodes").alias("length"), F.array_join("nodes", ",").alias("nodes"))


@register(Q, SQL, _CYCLES + """, rot AS (SELECT graph_id, list_reverse(nodes) AS r FROM cycles)
SELECT graph_id, array_to_string(r[list_position(r, list_min(r)):] || r[:list_position(r, list_min(r)) - 1], ',') AS nodes FROM rot""")  # fmt: skip
def cycle_canonical(spark, sf_dir):
    return _cycles(spark, sf_dir)[1].select("graph_id", F.array_join(E.canonical_cycle(F.reverse("nodes")), ",").alias("nodes"))


@register(Q, SQL, _CYCLES + "SELECT graph_id, array_to_string(nodes, ',') AS cycle, unnest(nodes) AS source, unnest(nodes[2:] || nodes[:1]) AS target FROM cycles")
def cycle_edges(spark, sf_dir):
    return _cycles(spark, sf_dir)[1].select("graph_id", F.array_join("nodes", ",").alias("cycle"), F.explode(E.cycle_edges("nodes")).alias("e")).select("graph_id", "cycle", "e.source", "e.target")


_NAMED = _CYCLES + ", named AS (SELECT graph_id, array_to_string(nodes, ' -> ') || ' -> ' || nodes[1] AS cycle_id, nodes FROM cycles)"


@register(Q, SQL, _NAMED + """, own AS (SELECT graph_id, cycle_id, unnest(nodes) AS src, unnest(nodes[2:] || nodes[:1]) AS dst FROM named)
SELECT n.graph_id, n.cycle_id, e.src, e.dst FROM named n JOIN edges e ON e.graph_id = n.graph_id AND list_contains(n.nodes, e.src) AND list_contains(n.nodes, e.dst)
WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.graph_id = n.graph_id AND o.cycle_id = n.cycle_id AND o.src = e.src AND o.dst = e.dst)""")  # fmt: skip
def chords(spark, sf_dir):
    return G.chords(*_chained(spark, sf_dir))


@register(Q, SQL, _NAMED + """SELECT n.graph_id, n.cycle_id, count(e.src)::BIGINT AS external_edges FROM named n
LEFT JOIN edges e ON e.graph_id = n.graph_id AND list_contains(n.nodes, e.src) <> list_contains(n.nodes, e.dst) GROUP BY ALL""")  # fmt: skip
def external_edges(spark, sf_dir):
    return G.external_edges(*_chained(spark, sf_dir))


@register(Q, SQL, TRADE_SQL + """SELECT graph_id, node, count(*) FILTER (d = 'i')::BIGINT AS indeg, count(*) FILTER (d = 'o')::BIGINT AS outdeg, count(*)::BIGINT AS total
FROM (SELECT graph_id, src AS node, 'o' AS d FROM edges UNION ALL SELECT graph_id, dst, 'i' FROM edges) GROUP BY ALL""")  # fmt: skip
def degrees(spark, sf_dir):
    return G.degrees(trade_edges(spark, sf_dir))


@register(Q, SQL, TRADE_SQL + """, d AS (SELECT graph_id, node, count(*) AS total FROM (SELECT graph_id, src AS node FROM edges UNION ALL SELECT graph_id, dst FROM edges) GROUP BY ALL)
SELECT graph_id, node, total::BIGINT AS total, p::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY total DESC, node) AS p FROM d) WHERE p <= 3""")  # fmt: skip
def hub_topk(spark, sf_dir):
    return G.hubs(trade_edges(spark, sf_dir), 3).select("graph_id", "node", "total", "place")


@register(Q, SQL, TRADE_SQL + """, n AS (SELECT graph_id, dst, count(*) AS n, min(pos) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) AS pos FROM edges) GROUP BY ALL)
SELECT graph_id, dst, n::BIGINT AS n, p::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, pos) AS p FROM n) WHERE p <= 3""")  # fmt: skip
def counter_topk(spark, sf_dir):
    return context.counter_top(trade_edges(spark, sf_dir), ["graph_id"], "dst", ["src", "dst"], 3).select("graph_id", "dst", "n", "place")


@register(Q, SQL, TRADE_SQL + """, g AS (SELECT graph_id, dst, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, dst) AS group_rank FROM (SELECT graph_id, dst, count(*) AS n FROM edges GROUP BY ALL)),
d AS (SELECT e.graph_id, e.src, e.dst, group_rank, row_number() OVER (PARTITION BY e.graph_id, e.dst ORDER BY e.src, e.dst) - 1 AS depth FROM edges e JOIN g USING (graph_id, dst)),
t AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY depth, group_rank) AS turn, count(*) OVER (PARTITION BY graph_id) AS total FROM d)
SELECT graph_id, src, dst, group_rank::INTEGER AS group_rank, depth::INTEGER AS depth, greatest(total - 5, 0)::BIGINT AS omitted FROM t WHERE turn <= 5""")  # fmt: skip
def roundrobin_sample(spark, sf_dir):
    return context.round_robin(trade_edges(spark, sf_dir), ["graph_id"], "dst", ["src", "dst"], 5).select("graph_id", "src", "dst", "group_rank", "depth", "omitted")


@register(Q, SQL, TRADE_SQL + "SELECT graph_id, src AS node, array_to_string(list_sort(list(DISTINCT dst)), ',') AS targets FROM edges GROUP BY ALL")
def adjacency(spark, sf_dir):
    return G.adjacency(trade_edges(spark, sf_dir)).where("targets is not null").select("graph_id", "node", F.array_join("targets", ",").alias("targets"))


def _catalog(spark, sf_dir, most=G.PACKED):
    edges = trade_edges(spark, sf_dir)
    members = G.strong_components(edges)
    cycles = G.cycle_ranks(G.enumerate_cycles(edges, members), G.pagerank(edges, G.graph_nodes(edges)))
    return edges, G.cycle_catalog(G.pack_edge_disjoint(cycles, most=most), G.rank_components(members))


#: The greedy choice, one cycle of a component after another.
_PACKED = _rank_sql(50, _CYCLES + _METRICS, """, own AS (SELECT row_number() OVER () AS no, c.graph_id, m.comp, nodes FROM cycles c JOIN members m ON m.graph_id = c.graph_id AND m.node = nodes[1]),
ranked AS (SELECT o.no, o.graph_id, o.comp, o.nodes, len(o.nodes) AS length, avg(r) AS pagerank_avg FROM (SELECT no, graph_id, comp, nodes, unnest(nodes) AS node FROM own) o JOIN {last} USING (graph_id, node) GROUP BY ALL),
placed AS (SELECT *, list_transform(range(1, length + 1), lambda i: nodes[i::INTEGER] || '>' || nodes[(i % length + 1)::INTEGER]) AS e, row_number() OVER (PARTITION BY graph_id, comp ORDER BY length DESC, pagerank_avg DESC, nodes DESC) AS k FROM ranked),
chosen AS (SELECT graph_id, comp, 0::BIGINT AS k, []::VARCHAR[] AS used, FALSE AS kept, 0 AS n FROM (SELECT DISTINCT graph_id, comp FROM placed)
  UNION ALL SELECT c.graph_id, c.comp, p.k, CASE WHEN list_has_any(used, e) OR n >= 200 THEN used ELSE used || e END, NOT (list_has_any(used, e) OR n >= 200), CASE WHEN list_has_any(used, e) OR n >= 200 THEN n ELSE n + 1 END
  FROM chosen c JOIN placed p ON p.graph_id = c.graph_id AND p.comp = c.comp AND p.k = c.k + 1)
SELECT p.graph_id, m.scc_id, m.scc_id || '_cycle_' || (c.n - 1) AS cycle_id, p.length::INTEGER AS length, array_to_string(p.nodes, ',') AS nodes, round(p.pagerank_avg, 9) AS pagerank_avg
FROM chosen c JOIN placed p ON p.graph_id = c.graph_id AND p.comp = c.comp AND p.k = c.k JOIN metrics m ON m.graph_id = c.graph_id AND m.comp = c.comp WHERE c.kept""")


def _packing(catalog):
    return catalog.select("graph_id", "scc_id", "cycle_id", "length", F.array_join("nodes", ",").alias("nodes"), F.round("pagerank_avg", 9).alias("pagerank_avg"))


@register(Q, SQL, _PACKED)
def edge_disjoint_packing(spark, sf_dir):
    return _packing(_catalog(spark, sf_dir)[1])


@register(Q, SQL, _PACKED)
def edge_disjoint_rounds(spark, sf_dir):
    """The packing of ``edge_disjoint_packing``, in rounds of joins, as that of large components."""
    return _packing(_catalog(spark, sf_dir, 0)[1])


@register(Q, SQL)
def greedy_selection(spark, sf_dir):
    bins = E.parse_bins("2-3,4-6,7-8")
    catalog = _catalog(spark, sf_dir)[1].withColumnRenamed("graph_id", "repo")
    repos = catalog.select("repo").distinct().withColumn("language", F.lit("python"))
    return select.greedy_selection(select.candidates(catalog, repos, bins), bins, 6, 2).select("pick_no", "repo", "cycle_id", "size", "bin")


_DRAW = "('0x' || substr(md5('12345|' || {g} || '|' || {c} || '|' || {a} || '|' || {s}), 1, 15))::BIGINT"


@register(Q, SQL, REACH_SQL + f""", i AS (SELECT e.graph_id, a.comp, e.src, e.dst FROM edges e JOIN members a ON a.graph_id = e.graph_id AND a.node = e.src JOIN members b ON b.graph_id = e.graph_id AND b.node = e.dst AND a.comp = b.comp),
steps AS (SELECT graph_id, comp, src, list(dst ORDER BY dst) AS next FROM i GROUP BY ALL), starts AS (SELECT graph_id, comp, list(src ORDER BY src) AS nodes FROM steps GROUP BY ALL),
walks AS (
  SELECT graph_id, comp, attempt, 0 AS step, nodes[({_DRAW.format(g='graph_id', c='comp', a='attempt', s='0')} % len(nodes) + 1)::INTEGER] AS cur, []::VARCHAR[] AS before FROM starts, (SELECT unnest(range(50000)) AS attempt)
  UNION ALL SELECT w.graph_id, w.comp, w.attempt, w.step + 1, next[({_DRAW.format(g='w.graph_id', c='w.comp', a='w.attempt', s='(w.step + 1)')} % len(next) + 1)::INTEGER], before || [cur]
  FROM walks w JOIN steps s ON s.graph_id = w.graph_id AND s.comp = w.comp AND s.src = w.cur WHERE NOT list_contains(before, cur) AND w.step < 8
), loops AS (SELECT DISTINCT graph_id, before[list_position(before, cur):] AS l FROM walks WHERE list_contains(before, cur))
SELECT DISTINCT graph_id, array_to_string(l[list_position(l, list_min(l)):] || l[:list_position(l, list_min(l)) - 1], ',') AS nodes FROM loops""")  # fmt: skip
def cycle_walks(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    return G.sample_cycles(edges, G.strong_components(edges)).select("graph_id", F.array_join("nodes", ",").alias("nodes"))


@register(Q, SQL)
def scc_summaries(spark, sf_dir):
    edges, cycles = _chained(spark, sf_dir)
    own = cycles.select("graph_id", "cycle_id").join(edges, "graph_id")
    return context.scc_summary(cycles, own, 3)


_RANKS = _rank_sql(50, _NAMED, "SELECT n.graph_id, n.cycle_id, round(avg(r) * min(n2.n), 6) AS centrality FROM (SELECT graph_id, cycle_id, unnest(nodes) AS node FROM named) n JOIN {last} USING (graph_id, node) JOIN size n2 USING (graph_id) GROUP BY ALL")


@register(Q, SQL, _RANKS.replace(", n2.n", ", n2.n"))
def relative_centrality(spark, sf_dir):
    edges, cycles = _chained(spark, sf_dir)
    return G.relative_centrality(cycles, G.pagerank(edges, G.graph_nodes(edges))).select("graph_id", "cycle_id", F.round("centrality", 6).alias("centrality"))

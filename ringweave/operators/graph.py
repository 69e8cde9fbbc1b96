"""Operators on directed graphs: components, PageRank, cycles, packing, degrees.

Edges are rows (graph_id, src, dst). Many graphs are worked on at once. A graph of at most ``GRAPH_EDGES`` edges is
one task's work, by an in-memory algorithm on its group; larger graphs go through joins that converge in rounds,
each round written to the shared folder. Both give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..session import drop_stored, ship_package, stored

GRAPH_EDGES = 2_000_000


def clean_edges(edges: DataFrame, self_loops: bool = False) -> DataFrame:
    """Distinct edges with both ends; self-loops dropped unless asked for."""
    own = edges.select("graph_id", "src", "dst").where("src is not null and dst is not null")
    return (own if self_loops else own.where("src <> dst")).distinct()


def graph_nodes(edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Declared nodes and ends of edges (graph_id, node)."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return (ends if declared is None else declared.select("graph_id", "node").union(ends)).where("node is not null").distinct()


def _by_size(edges: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges of graphs that fit one task, and of those that don't (None: there are none)."""
    sizes = edges.groupBy("graph_id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).select("graph_id")
    found = sizes.agg(F.max("n").alias("m"), F.min("n").alias("l")).first()
    if not found["m"] or found["m"] <= most:
        return edges, None
    if found["l"] > most:
        return None, edges
    return edges.join(large, "graph_id", "left_anti"), edges.join(large, "graph_id", "left_semi")


def _numbered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order, and the edges' ends as their numbers."""
    names, at = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
    return names, at[: len(pdf)], at[len(pdf) :]


def _components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least member of each node's strong component: two depth-first passes, without recursion."""

    def starts(a, b):
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(n + 1)), b[order]

    first, to = starts(src, dst)
    seen, finished = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, first[root])]
        while stack:
            v, i = stack.pop()
            while i < first[v + 1] and seen[to[i]]:
                i += 1
            if i < first[v + 1]:
                w = to[i]
                seen[w] = True
                stack += [(v, i + 1), (w, first[w])]
            else:
                finished.append(v)
    first, to = starts(dst, src)
    comp = np.full(n, -1)
    for root in reversed(finished):
        if comp[root] >= 0:
            continue
        members, stack = [], [root]
        comp[root] = root
        while stack:
            v = stack.pop()
            members.append(v)
            for w in to[first[v] : first[v + 1]]:
                if comp[w] < 0:
                    comp[w] = root
                    stack.append(w)
        comp[members] = min(members)
    return comp


def _rounds(edges: DataFrame) -> DataFrame:
    """Strong components of large graphs by colours: the greatest node that reaches a node colours it; the nodes of a
    colour that reach back to it are its component; they leave, and it starts anew."""
    live = stored(edges, "scc-live")
    done, n = None, live.count()
    while n:
        # nodes without a way in or out are no part of a cycle
        while True:
            ins, outs = live.select("graph_id", F.col("dst").alias("src")).distinct(), live.select("graph_id", F.col("src").alias("dst")).distinct()
            trimmed = stored(live.join(ins, ["graph_id", "src"], "left_semi").join(outs, ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst"), "scc-trim")
            live, was, n = trimmed, n, trimmed.count()
            if n == was:
                break
        nodes = graph_nodes(live)
        colour = stored(nodes.withColumn("c", F.col("node")), "scc-colour")
        while True:
            pushed = live.join(colour.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"), "c")
            after = stored(colour.unionByName(pushed).groupBy("graph_id", "node").agg(F.max("c").alias("c")), "scc-colour")
            changed = after.join(colour, ["graph_id", "node", "c"], "left_anti").limit(1).count()
            drop_stored(colour)
            colour = after
            if not changed:
                break
        inside = live.join(colour.select("graph_id", F.col("node").alias("src"), "c"), ["graph_id", "src"]).join(
            colour.select("graph_id", F.col("node").alias("dst"), F.col("c").alias("c2")), ["graph_id", "dst"]
        )
        inside = stored(inside.where("c = c2").select("graph_id", "src", "dst", "c"), "scc-inside")
        reached = stored(colour.where("node = c"), "scc-reach")
        size = reached.count()
        while True:
            more = inside.join(reached.select("graph_id", F.col("node").alias("dst"), "c"), ["graph_id", "dst", "c"]).select("graph_id", F.col("src").alias("node"), "c")
            after = stored(reached.unionByName(more).distinct(), "scc-reach")
            was, size = size, after.count()
            drop_stored(reached)
            reached = after
            if size == was:
                break
        done = reached if done is None else done.unionByName(reached)
        gone = reached.select("graph_id", "node")
        live = stored(
            live.join(gone.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_anti")
            .join(gone.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_anti")
            .select("graph_id", "src", "dst"),
            "scc-live",
        )
        n = live.count()
    if done is None:
        return edges.select("graph_id", F.col("src").alias("node"), F.col("src").alias("comp")).limit(0)
    least = done.groupBy("graph_id", "c").agg(F.min("node").alias("comp"))
    return done.join(least, ["graph_id", "c"]).select("graph_id", "node", "comp")


def strong_components(edges: DataFrame, self_loops: bool = False, most: int = GRAPH_EDGES) -> DataFrame:
    """Nodes of cyclic components: graph_id, node, comp (its least node).

    A component is cyclic if it has two nodes or more, or, with ``self_loops``, one with an edge to itself.
    """
    ship_package(edges.sparkSession)
    own = clean_edges(edges, self_loops)
    small, large = _by_size(own, most)
    schema = own.select("graph_id", F.col("src").alias("node"), F.col("src").alias("comp")).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, a, b = _numbered(pdf)
        comp = _components(len(names), a, b)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node": names, "comp": names[comp]})

    parts = []
    if small is not None:
        parts.append(small.groupBy("graph_id").applyInPandas(solve, schema))
    if large is not None:
        parts.append(_rounds(large.where("src <> dst")))
        if self_loops:
            loops = large.where("src = dst").select("graph_id", F.col("src").alias("node"), F.col("src").alias("comp"))
            parts[-1] = parts[-1].unionByName(loops.join(parts[-1], ["graph_id", "node"], "left_anti"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    size = F.count("*").over(Window.partitionBy("graph_id", "comp"))
    found = found.withColumn("_n", size)
    if not self_loops:
        return found.where("_n > 1").drop("_n")
    loops = own.where("src = dst").select("graph_id", F.col("src").alias("node"), F.lit(True).alias("_loop"))
    return found.join(loops, ["graph_id", "node"], "left").where("_n > 1 or _loop").select("graph_id", "node", "comp")


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends lie in one component: graph_id, comp, src, dst."""
    a = members.select("graph_id", F.col("node").alias("src"), "comp")
    b = members.select("graph_id", F.col("node").alias("dst"), "comp")
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst", "comp"]).select("graph_id", "comp", "src", "dst")


def rank_components(members: DataFrame) -> DataFrame:
    """Names scc_0, scc_1, ... of each graph's components: larger first, then by node list, last first."""
    comps = members.groupBy("graph_id", "comp").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("nodes"))
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("size"), F.desc("nodes"))) - 1
    return comps.withColumn("scc_id", F.concat(F.lit("scc_"), place.cast("string")))


def scc_metrics(edges: DataFrame, members: DataFrame, loc: DataFrame | None = None) -> DataFrame:
    """Measures of each component: size, edge_count, density, edge surplus of the undirected view, lines of code."""
    inside = induced_edges(edges, members)
    m = inside.groupBy("graph_id", "comp").agg(
        F.count("*").alias("edge_count"), F.countDistinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("undirected")
    )
    out = rank_components(members).join(m, ["graph_id", "comp"], "left").fillna(0, ["edge_count", "undirected"])
    if loc is not None:
        lines = members.join(loc, ["graph_id", "node"], "left").groupBy("graph_id", "comp").agg(F.sum(F.coalesce("loc", F.lit(0))).alias("total_loc"))
        out = out.join(lines, ["graph_id", "comp"]).withColumn("avg_loc_per_node", F.bround(F.col("total_loc") / F.col("size"), 2))
    return out.withColumns(
        {
            "density_directed": F.when(F.col("size") > 1, F.bround(F.col("edge_count") / (F.col("size") * (F.col("size") - 1)), 6)).otherwise(0.0),
            "edge_surplus_lb": F.greatest(F.lit(0), F.col("undirected") - (F.col("size") - 1)),
            "redundancy": F.greatest(F.lit(0), F.col("edge_count") - F.col("size")),
        }
    )


def scc_global(metrics: DataFrame) -> DataFrame:
    """Totals of each graph's components."""
    return metrics.groupBy("graph_id").agg(
        F.count("*").alias("scc_count"),
        F.sum("size").alias("total_nodes"),
        F.sum("edge_count").alias("total_edges"),
        F.max("size").alias("max_scc_size"),
        F.bround(F.avg("size"), 3).alias("avg_scc_size"),
        F.sum("edge_surplus_lb").alias("cycle_pressure_lb"),
        F.sum("redundancy").alias("redundancy"),
    )


def pagerank(
    edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 50, tol: float | None = None, no_edges: str = "uniform", most: int = GRAPH_EDGES
) -> DataFrame:
    """(graph_id, node, rank). Ranks of nodes without edges out are spread evenly.

    Without ``tol`` exactly so many rounds are made; with it they end once the ranks change by less than tol for
    each node in sum. ``no_edges``: ranks in a graph without edges, ``uniform`` or ``zero``.
    """
    ship_package(edges.sparkSession)
    both = nodes.select("graph_id", F.col("node").alias("src"), F.lit(None).cast(nodes.schema["node"].dataType).alias("dst")).unionByName(edges.select("graph_id", "src", "dst"))
    small, large = _by_size(both, most)
    schema = nodes.select("graph_id", "node", F.lit(0.0).alias("rank")).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gid = pdf["graph_id"].iloc[0]
        names = np.sort(pdf.loc[pdf["dst"].isna(), "src"].unique())
        e = pdf[pdf["dst"].notna()].drop_duplicates()
        e = e[e["src"].isin(names) & e["dst"].isin(names)]
        n = len(names)
        if not len(e) and no_edges == "zero":
            return pd.DataFrame({"graph_id": gid, "node": names, "rank": 0.0})
        a, b = np.searchsorted(names, e["src"]), np.searchsorted(names, e["dst"])
        out = np.bincount(a, minlength=n)
        r = np.full(n, 1.0 / n)
        for _ in range(iterations):
            new = (1 - damping) / n + damping * r[out == 0].sum() / n + damping * np.bincount(b, weights=r[a] / out[a], minlength=n)
            moved, r = np.abs(new - r).sum(), new
            if tol is not None and moved < n * tol:
                break
        return pd.DataFrame({"graph_id": gid, "node": names, "rank": r})

    parts = []
    if small is not None:
        parts.append(small.groupBy("graph_id").applyInPandas(solve, schema))
    if large is not None:
        parts.append(_pagerank_rounds(large, damping, iterations, tol, no_edges))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _pagerank_rounds(both: DataFrame, damping: float, iterations: int, tol: float | None, no_edges: str) -> DataFrame:
    """PageRank of large graphs by joins; each round is written to the shared folder."""
    nodes = both.where("dst is null").select("graph_id", F.col("src").alias("node")).distinct()
    e = both.where("dst is not null").distinct()
    for end in ("src", "dst"):
        e = e.join(nodes.withColumnRenamed("node", end), ["graph_id", end], "left_semi")
    e = e.select("graph_id", "src", "dst")
    count = nodes.groupBy("graph_id").agg(F.count("*").cast("double").alias("n"))
    out = e.groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias("out"))
    state = stored(nodes.join(count, "graph_id").join(out, ["graph_id", "node"], "left").withColumn("rank", 1 / F.col("n")), "rank")
    e = stored(e, "rank-edges")
    for _ in range(iterations):
        share = e.join(state.withColumnRenamed("node", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        sunk = state.where("out is null").groupBy("graph_id").agg(F.sum("rank").alias("sunk"))
        new = state.join(share, ["graph_id", "node"], "left").join(sunk, "graph_id", "left")
        fresh = (1 - damping) / F.col("n") + damping * F.coalesce("sunk", F.lit(0.0)) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))
        new = new.select("graph_id", "node", "n", "out", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved"))
        new = stored(new, "rank")  # a round reads the one before three times, so its plan must not hold that one's
        drop_stored(state)
        if tol is not None and not new.groupBy("graph_id", "n").agg(F.sum("moved").alias("m")).where(F.col("m") >= F.col("n") * tol).limit(1).count():
            state = new
            break
        state = new.drop("moved")
        state._stored_at = new._stored_at
    rank = F.when(F.lit(no_edges == "zero") & F.col("any").isNull(), 0.0).otherwise(F.col("rank"))
    some = e.select("graph_id").distinct().withColumn("any", F.lit(1))
    return state.join(some, "graph_id", "left").select("graph_id", "node", rank.alias("rank"))


def enumerate_cycles(edges: DataFrame, members: DataFrame, max_len: int = 8) -> DataFrame:
    """All simple cycles of 2 to ``max_len`` nodes: graph_id, comp, nodes (least first).

    Paths grow by one join a round from their least node, through larger nodes of the component only, so each cycle
    is found once and in its canonical form.
    """
    inside = stored(induced_edges(clean_edges(edges), members), "cycle-edges")
    step = inside.select("graph_id", "comp", F.col("src").alias("cur"), F.col("dst").alias("nxt"))
    paths = inside.where("dst > src").select("graph_id", "comp", F.col("src").alias("start"), F.col("dst").alias("cur"), F.array("src", "dst").alias("nodes"))
    found = []
    for n in range(2, max_len + 1):
        paths = stored(paths, "cycle-paths")
        grown = paths.join(step, ["graph_id", "comp", "cur"])
        found.append(grown.where("nxt = start").select("graph_id", "comp", "nodes"))
        if n == max_len:
            break
        paths = grown.where((F.col("nxt") > F.col("start")) & ~F.array_contains("nodes", F.col("nxt"))).select(
            "graph_id", "comp", "start", F.col("nxt").alias("cur"), F.concat("nodes", F.array("nxt")).alias("nodes")
        )
        if not paths.limit(1).count():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _draw(seed: int, step: int, n: Column | str) -> Column:
    """A whole number below ``n`` for a walk (graph_id, comp, attempt) at a step: 60 bits of an MD5, modulo n.

    It follows from its names alone, so walks are the same for any partitioning and on any engine.
    """
    name = F.concat_ws("|", F.lit(str(seed)), F.col("graph_id").cast("string"), F.col("comp").cast("string"), F.col("attempt").cast("string"), F.lit(str(step)))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long") % E.col(n)


def sample_cycles(edges: DataFrame, members: DataFrame, max_len: int = 8, attempts: int = 50_000, seed: int = 12345) -> DataFrame:
    """Cycles met by random walks in each component: graph_id, comp, nodes (least first).

    A walk starts at any node and takes up to ``max_len`` steps; the first node it meets again closes a cycle, which
    counts if it has 2 to ``max_len`` nodes. All walks of all components step together, by one join a step on a node and
    the number of one of its edges; a node's edges lie apart, so walks through a hub do too.
    """
    inside = stored(induced_edges(clean_edges(edges), members), "walk-edges")
    own = Window.partitionBy("graph_id", "comp")
    degree = inside.groupBy("graph_id", "comp", "src").agg(F.count("*").alias("degree"))
    place = F.row_number().over(Window.partitionBy("graph_id", "comp", "src").orderBy("dst")) - 1
    to = degree.select("graph_id", "comp", F.col("src").alias("dst"), F.col("degree").alias("next_degree"))
    steps = stored(inside.withColumn("k", place.cast("long")).join(to, ["graph_id", "comp", "dst"]).select("graph_id", "comp", F.col("src").alias("cur"), "k", "dst", "next_degree"), "walk-steps")
    starts = degree.select("graph_id", "comp", (F.row_number().over(own.orderBy("src")) - 1).cast("long").alias("k"), F.col("src").alias("cur"), "degree")
    size = degree.groupBy("graph_id", "comp").agg(F.count("*").alias("n"))
    walks = size.select("graph_id", "comp", "n", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt")) if attempts > 0 else size.withColumn("attempt", F.lit(0)).limit(0)
    walks = walks.withColumn("k", _draw(seed, 0, "n")).join(starts, ["graph_id", "comp", "k"])
    walks = walks.select("graph_id", "comp", "attempt", "cur", "degree", F.array("cur").alias("path"), F.lit(None).cast(f"array<{inside.schema['src'].dataType.simpleString()}>").alias("nodes"))
    for step in range(1, max_len + 1):
        # walks that have ended go on without a node, spread by their number
        walks = walks.withColumn("k", F.when(F.col("cur").isNull(), F.col("attempt").cast("long")).otherwise(_draw(seed, step, "degree"))).join(steps, ["graph_id", "comp", "cur", "k"], "left")
        at = F.when(F.col("cur").isNotNull(), F.array_position("path", F.col("dst")).cast("int"))
        on = at == 0
        walks = walks.select(
            "graph_id", "comp", "attempt", F.when(on, F.col("dst")).alias("cur"), F.when(on, F.col("next_degree")).alias("degree"),
            F.when(on, F.concat("path", F.array("dst"))).alias("path"), F.when(at > 0, F.slice("path", at, F.size("path"))).otherwise(F.col("nodes")).alias("nodes"),
        )
    closed = walks.where(F.size("nodes") >= 2).select("graph_id", "comp", E.canonical_cycle("nodes").alias("nodes"))
    return closed.distinct()


#: Paths that may have to be followed in a component of which all cycles are listed.
PATHS = 10_000_000


def find_cycles(edges: DataFrame, members: DataFrame, max_len: int = 8, attempts: int = 50_000, seed: int = 12345, most: int = PATHS) -> DataFrame:
    """Cycles of 2 to ``max_len`` nodes: graph_id, comp, nodes. All of them where a component is small enough, those that
    random walks meet in the others, where they may be too many to be listed.

    Small enough is a component with ``most`` paths or less by the bound nodes * (largest out-degree) ** (max_len - 1).
    """
    inside = induced_edges(clean_edges(edges), members)
    out = inside.groupBy("graph_id", "comp", "src").agg(F.count("*").alias("d")).groupBy("graph_id", "comp").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    few = out.where(F.col("n") * F.pow("d", F.lit(max_len - 1)) <= most).select("graph_id", "comp")
    part = lambda how: members.join(few, ["graph_id", "comp"], how)
    return enumerate_cycles(edges, part("left_semi"), max_len).unionByName(sample_cycles(edges, part("left_anti"), max_len, attempts, seed))


def cycle_ranks(cycles: DataFrame, ranks: DataFrame) -> DataFrame:
    """``cycles`` with length and the mean, least and greatest PageRank of their nodes (absent nodes: 0)."""
    long = cycles.select("graph_id", "comp", "nodes", F.explode("nodes").alias("node")).join(ranks, ["graph_id", "node"], "left")
    r = F.coalesce("rank", F.lit(0.0))
    return long.groupBy("graph_id", "comp", "nodes").agg(
        F.count("*").cast("int").alias("length"), F.avg(r).alias("pagerank_avg"), F.min(r).alias("pagerank_min"), F.max(r).alias("pagerank_max")
    )


#: Cycles of a component that one task packs.
PACKED = 100_000


def pack_edge_disjoint(cycles: DataFrame, max_keep: int = 200, most: int = PACKED) -> DataFrame:
    """Of each component the cycles taken greedily, longest, then highest mean rank, then last node list first, so
    that no edge is in two: ``cycles`` with place (from 0).

    Means are compared by their first 12 digits. Nodes of equal rank make means that differ only in how their sums were
    rounded, which follows from the order of rows; these count as equal, and the node list decides.

    A component of at most ``most`` cycles is one task's; larger ones are packed in rounds. Both give the same rows.
    """
    import pyspark.sql.types as T

    schema = T.StructType([*cycles.schema.fields, T.StructField("place", T.IntegerType())])
    cycles = cycles.withColumn("_mean", F.format_string("%.11e", "pagerank_avg").cast("double"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["length"], pdf["_mean"], map(tuple, pdf["nodes"])))
        used, kept = set(), []
        for i in sorted(range(len(rows)), key=rows.__getitem__, reverse=True):
            nodes = rows[i][2]
            own = set(zip(nodes, nodes[1:] + nodes[:1]))
            if used & own:
                continue
            used |= own
            kept.append(i)
            if max_keep > 0 and len(kept) >= max_keep:
                break
        return pdf.iloc[kept].drop(columns="_mean").assign(place=np.arange(len(kept), dtype="int32"))

    own = ["graph_id", "comp"]
    sizes = cycles.groupBy(*own).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > most).select(*own)
    if not large.limit(1).count():
        return cycles.groupBy(*own).applyInPandas(pack, schema)
    small = cycles.join(large, own, "left_anti").groupBy(*own).applyInPandas(pack, schema)
    return small.unionByName(_pack_rounds(cycles.join(large, own, "left_semi"), max_keep).select(*schema.names))


def _pack_rounds(cycles: DataFrame, max_keep: int) -> DataFrame:
    """Greedy packing without an order of steps: in each round every cycle is taken that comes first on all of its edges,
    and those that share an edge with one taken leave. What is taken is what the greedy choice takes: a cycle that comes
    first on its edges has no earlier rival left. Each round is written to the shared folder."""
    own, order = ["graph_id", "comp"], F.struct("length", "_mean", "nodes").alias("rank")
    ends = F.explode(E.cycle_edges("rank.nodes")).alias("e")
    live = stored(cycles.select(*own, order), "pack-live")
    taken = None
    while live.limit(1).count():
        edges = stored(live.select(*own, "rank", ends).select(*own, "rank", F.col("e.source").alias("src"), F.col("e.target").alias("dst")), "pack-edges")
        first = edges.groupBy(*own, "src", "dst").agg(F.max("rank").alias("first"))
        leads = edges.join(first, [*own, "src", "dst"]).groupBy(*own, "rank").agg(F.bool_and(F.col("rank") == F.col("first")).alias("leads"))
        won = stored(leads.where("leads").select(*own, "rank"), "pack-won")
        used = won.select(*own, ends).select(*own, F.col("e.source").alias("src"), F.col("e.target").alias("dst"))
        lost = edges.join(used, [*own, "src", "dst"], "left_semi").select(*own, "rank").distinct()
        rest = stored(live.join(lost, [*own, "rank"], "left_anti"), "pack-live")
        drop_stored(live)
        drop_stored(edges)
        live, taken = rest, won if taken is None else taken.unionByName(won)
    if taken is None:
        taken = live
    place = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("rank"))) - 1
    placed = taken.withColumn("place", place)
    kept = placed.where(F.col("place") < max_keep) if max_keep > 0 else placed
    return kept.select(*own, F.col("rank.nodes").alias("nodes"), "place").join(cycles, [*own, "nodes"])


def cycle_catalog(packed: DataFrame, sccs: DataFrame) -> DataFrame:
    """Packed cycles with their names: scc_id, cycle_id (scc_<i>_cycle_<place>), nodes, edges, ranks."""
    named = packed.join(sccs.select("graph_id", "comp", "scc_id"), ["graph_id", "comp"])
    return named.select(
        "graph_id",
        "scc_id",
        F.concat_ws("_", "scc_id", F.lit("cycle"), F.col("place").cast("string")).alias("cycle_id"),
        "length",
        "nodes",
        E.cycle_edges("nodes").alias("edges"),
        "pagerank_avg",
        "pagerank_min",
        "pagerank_max",
    )


def lost_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct edges of graphs that aren't in the graphs after."""
    own = ("graph_id", "src", "dst")
    return before.select(*own).subtract(after.select(*own))


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, indeg, outdeg, total, in one aggregation."""
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("graph_id", "x.node").agg(F.sum("x.i").alias("indeg"), F.sum("x.o").alias("outdeg")).withColumn("total", F.col("indeg") + F.col("outdeg"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes of each graph with most edges; ties by name."""
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("total"), "node"))
    return degrees(edges).withColumn("place", place).where(F.col("place") <= k)


def chords(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Edges between nodes of a cycle (graph_id, cycle_id, nodes) that aren't its own."""
    member = cycles.select("graph_id", "cycle_id", F.explode("nodes").alias("node"))
    inside = edges.join(member.withColumnRenamed("node", "src"), ["graph_id", "src"]).join(member.withColumnRenamed("node", "dst"), ["graph_id", "cycle_id", "dst"])
    own = cycles.select("graph_id", "cycle_id", F.explode(E.cycle_edges("nodes")).alias("e")).select("graph_id", "cycle_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst"))
    return inside.select("graph_id", "cycle_id", "src", "dst").distinct().join(own, ["graph_id", "cycle_id", "src", "dst"], "left_anti")


def external_edges(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """How many edges have exactly one end in each cycle, 0 where there are none."""
    member = cycles.select("graph_id", "cycle_id", F.explode("nodes").alias("node"))
    touch = edges.join(member.withColumnRenamed("node", "src"), ["graph_id", "src"]).select("graph_id", "cycle_id", "src", "dst")
    touch = touch.unionByName(edges.join(member.withColumnRenamed("node", "dst"), ["graph_id", "dst"]).select("graph_id", "cycle_id", "src", "dst"))
    # an edge with both ends inside is there twice, with one end once
    one = touch.groupBy("graph_id", "cycle_id", "src", "dst").agg(F.count("*").alias("n")).where("n = 1").groupBy("graph_id", "cycle_id").agg(F.count("*").alias("n"))
    return cycles.select("graph_id", "cycle_id").join(one, ["graph_id", "cycle_id"], "left").select("graph_id", "cycle_id", F.coalesce("n", F.lit(0)).cast("long").alias("external_edges"))


def relative_centrality(cycles: DataFrame, ranks: DataFrame) -> DataFrame:
    """Mean PageRank of a cycle's nodes times the number of nodes of its graph; 1 is average."""
    size = ranks.groupBy("graph_id").agg(F.count("*").alias("n"))
    member = cycles.select("graph_id", "cycle_id", F.explode("nodes").alias("node"))
    mean = member.join(ranks, ["graph_id", "node"]).groupBy("graph_id", "cycle_id").agg(F.avg("rank").alias("m"))
    return mean.join(size, "graph_id").select("graph_id", "cycle_id", (F.col("m") * F.col("n")).alias("centrality"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted sets of targets and sources of each node."""
    out = edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    inn = edges.groupBy("graph_id", F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("sources"))
    return out.join(inn, ["graph_id", "node"], "full")


def classify(nodes: DataFrame, edges: DataFrame, members: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph by the innermost thing they are in: selected (a cycle), scc or graph."""
    in_cycle = cycles.select("graph_id", F.explode("nodes").alias("node")).distinct().withColumn("c", F.lit(True))
    ring = cycles.select("graph_id", F.explode(E.cycle_edges("nodes")).alias("e")).select("graph_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst")).distinct().withColumn("c", F.lit(True))
    kind = F.when(F.col("c"), "selected").when(F.col("comp").isNotNull(), "scc").otherwise("graph").alias("kind")
    n = nodes.join(members, ["graph_id", "node"], "left").join(in_cycle, ["graph_id", "node"], "left").select("graph_id", "node", E.short_label("node").alias("label"), kind)
    e = edges.join(induced_edges(edges, members), ["graph_id", "src", "dst"], "left").join(ring, ["graph_id", "src", "dst"], "left").select("graph_id", "src", "dst", kind)
    return n, e

"""Walks, packing and selection of cycles against plain searches."""

import hashlib
import random

import numpy as np
import pytest
from ringweave.functions import exprs as E
from ringweave.operators import graph as G
from ringweave.operators import select
from test_evaluate import slow_selection


def random_graph(n, m, seed, graph="g"):
    rng = random.Random(seed)
    return sorted({(graph, f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def plain_walks(edges, members, max_len, attempts, seed=12345):
    comp = {(g, n): c for g, n, c in members}
    out: dict = {}
    for g, a, b in edges:
        if comp.get((g, a)) is not None and comp.get((g, a)) == comp.get((g, b)):
            out.setdefault((g, comp[g, a]), {}).setdefault(a, []).append(b)
    found = set()
    for (g, c), next_of in out.items():
        nodes = sorted(next_of)

        def draw(attempt, step, n):
            return int(hashlib.md5(f"{seed}|{g}|{c}|{attempt}|{step}".encode()).hexdigest()[:15], 16) % n

        for attempt in range(attempts):
            path = [nodes[draw(attempt, 0, len(nodes))]]
            for step in range(1, max_len + 1):
                near = sorted(next_of[path[-1]])
                cur = near[draw(attempt, step, len(near))]
                if cur in path:
                    loop = path[path.index(cur) :]
                    k = loop.index(min(loop))
                    found.add((g, c, tuple(loop[k:] + loop[:k])))
                    break
                path.append(cur)
    return found


def test_walks_are_those_of_plain_code_for_any_partitioning(spark):
    rows = random_graph(12, 40, 1) + random_graph(5, 12, 2, "h") + [("two", "x", "y"), ("two", "y", "x"), ("none", "x", "y")]
    e = spark.createDataFrame(rows, "graph_id string, src string, dst string")
    members = G.strong_components(e)
    want = plain_walks(rows, [tuple(r) for r in members.select("graph_id", "node", "comp").collect()], 5, 300)
    for n in (1, 7):
        got = G.sample_cycles(e.repartition(n), members.repartition(n), 5, 300)
        assert {(r["graph_id"], r["comp"], tuple(r["nodes"])) for r in got.collect()} == want
        assert got.count() == len(want)
    assert len(want) > 20
    assert G.sample_cycles(e, members, 5, 0).count() == 0
    assert G.sample_cycles(e.limit(0), members, 5, 10).count() == 0


def test_packing_in_rounds_is_the_sequential_one(spark):
    e = spark.createDataFrame(random_graph(9, 70, 3) + random_graph(6, 20, 4, "h"), "graph_id string, src string, dst string")
    members = G.strong_components(e)
    cycles = G.stored(G.cycle_ranks(G.enumerate_cycles(e, members, 5), G.pagerank(e, G.graph_nodes(e))), "cycles")
    rows = lambda df: sorted((r["graph_id"], r["comp"], r["place"], tuple(r["nodes"])) for r in df.collect())
    assert cycles.count() > 100
    whole = rows(G.pack_edge_disjoint(cycles))
    assert rows(G.pack_edge_disjoint(cycles, most=0)) == whole and len(whole) > 5
    assert rows(G.pack_edge_disjoint(cycles, most=60)) == whole  # one graph either way
    assert rows(G.pack_edge_disjoint(cycles, 3, most=0)) == [r for r in whole if r[2] < 3]
    assert rows(G.pack_edge_disjoint(cycles.limit(0), most=0)) == []


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_picks_one_by_one(spark, seed):
    rng = random.Random(seed)
    bins = E.parse_bins("2-3,4-6,7-8")
    pool = []
    for r in range(rng.randrange(1, 9)):
        for k in range(rng.randrange(1, 14)):
            size = rng.randrange(2, 9)
            pool.append(dict(repo=f"r{r}", cycle_id=f"c{k}", nodes=rng.sample([f"n{i}" for i in range(12)], size), size=size, bin=next(b for lo, hi, b in bins if lo <= size <= hi)))
    cands = spark.createDataFrame(pool, "repo string, cycle_id string, nodes array<string>, size int, bin string")
    total, most = rng.randrange(3, 14), rng.randrange(1, 5)
    got = select.greedy_selection(cands, bins, total, most)
    assert [{k: v for k, v in r.asDict().items() if k != "pick_no"} for r in got.orderBy("pick_no").collect()] == slow_selection(pool, bins, total, most)


def test_jobs_of_a_selection_do_not_depend_on_its_picks(spark):
    bins = E.parse_bins("2-3,4-6")
    pool = [dict(repo=f"r{r:03d}", cycle_id=f"c{k}", nodes=[f"n{k}{i}" for i in range(2 + k % 5)], size=2 + k % 5, bin="2-3" if k % 5 < 2 else "4-6") for r in range(60) for k in range(10)]
    cands = spark.createDataFrame(pool, "repo string, cycle_id string, nodes array<string>, size int, bin string")
    jobs = [select.greedy_selection(cands, bins, total, 3)._jobs for total in (40, 80, 120)]
    assert max(jobs) <= 8


def test_means_that_differ_by_rounding_are_ties(spark):
    """A last bit of a mean follows from the order of a sum; the node list decides, whichever way the bit lies."""
    up = float(np.nextafter(0.2, 1))
    for a, b in ((up, 0.2), (0.2, up), (0.2, 0.2)):
        rows = [("g", "a", ["a", "b", "c"], 3, a), ("g", "a", ["a", "b", "d"], 3, b), ("h", "a", ["a", "b"], 2, 2e-9), ("h", "a", ["b", "a"], 2, 1e-9)]
        cycles = spark.createDataFrame(rows, "graph_id string, comp string, nodes array<string>, length int, pagerank_avg double")
        for most in (G.PACKED, 0):
            got = {(r["graph_id"], "".join(r["nodes"]), r["pagerank_avg"]) for r in G.pack_edge_disjoint(cycles, most=most).collect()}
            assert got == {("g", "abd", b), ("h", "ab", 2e-9)}

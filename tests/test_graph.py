import itertools
import random

import pytest

from ringweave.operators import graph as G


def edges_df(spark, rows, gid="g"):
    return spark.createDataFrame([(gid, a, b) for a, b in rows], "graph_id string, src string, dst string")


def reach(rows):
    nodes = sorted({x for e in rows for x in e})
    r = {(a, b) for a, b in rows}
    for k, i, j in itertools.product(nodes, nodes, nodes):
        if (i, k) in r and (k, j) in r:
            r.add((i, j))
    return nodes, r


def brute_components(rows, loops=False):
    nodes, r = reach([e for e in rows if loops or e[0] != e[1]])
    out = {}
    for n in nodes:
        own = sorted({m for m in nodes if (n, m) in r and (m, n) in r and m != n} | {n})
        if len(own) > 1 or (loops and (n, n) in rows):
            out[n] = own[0]
    return out


CASES = {
    "three-cycle": [("a", "b"), ("b", "c"), ("c", "a")],
    "chord": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")],
    "figure eight": [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")],
    "two equal": [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c")],
    "self-loop": [("a", "a"), ("a", "b")],
    "dag": [("a", "b"), ("b", "c"), ("a", "c")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("loops", [False, True])
@pytest.mark.parametrize("most", [G.GRAPH_EDGES, 0])
def test_components(spark, name, loops, most):
    rows = CASES[name]
    got = {r["node"]: r["comp"] for r in G.strong_components(edges_df(spark, rows), loops, most).collect()}
    assert got == brute_components(rows, loops)


def test_random_components_both_ways(spark):
    rng = random.Random(3)
    rows = [(gid, f"n{rng.randrange(12):02}", f"n{rng.randrange(12):02}") for gid in "xy" for _ in range(16)]
    df = spark.createDataFrame(rows, "graph_id string, src string, dst string")
    want = {(g, n): c for g in "xy" for n, c in brute_components([(a, b) for i, a, b in rows if i == g]).items()}
    for most in (G.GRAPH_EDGES, 0):
        assert {(r["graph_id"], r["node"]): r["comp"] for r in G.strong_components(df, most=most).collect()} == want


def test_rank_order(spark):
    rows = CASES["two equal"] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = {r["scc_id"]: r["nodes"] for r in G.rank_components(G.strong_components(edges_df(spark, rows))).collect()}
    assert got == {"scc_0": ["x", "y", "z"], "scc_1": ["c", "d"], "scc_2": ["a", "b"]}


def test_pagerank_small_and_large(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]  # d dangles
    e = edges_df(spark, rows)
    nodes = G.graph_nodes(e)
    small = {r["node"]: r["rank"] for r in G.pagerank(e, nodes, iterations=11).collect()}
    large = {r["node"]: r["rank"] for r in G.pagerank(e, nodes, iterations=11, most=0).collect()}
    assert sum(small.values()) == pytest.approx(1)
    assert large == pytest.approx(small)
    ranks = dict.fromkeys("abcd", 0.25)
    for _ in range(11):
        new = dict.fromkeys("abcd", 0.15 / 4 + 0.85 * ranks["d"] / 4)
        for a, b in rows:
            new[b] += 0.85 * ranks[a] / sum(x == a for x, _ in rows)
        ranks = new
    assert small == pytest.approx(ranks)


def test_pagerank_without_edges(spark):
    nodes = spark.createDataFrame([("g", "a"), ("g", "b")], "graph_id string, node string")
    none = edges_df(spark, [("a", "b")]).limit(0)
    assert [r["rank"] for r in G.pagerank(none, nodes, no_edges="zero").collect()] == [0.0, 0.0]
    assert [r["rank"] for r in G.pagerank(none, nodes).collect()] == pytest.approx([0.5, 0.5])


def test_cycles_against_brute_force(spark):
    rng = random.Random(5)
    rows = sorted({(a, b) for a, b in ((f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(22)) if a != b})
    nodes = sorted({x for e in rows for x in e})
    want = set()
    for n in range(2, 5):
        for p in itertools.permutations(nodes, n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in rows for i in range(n)):
                want.add(p)
    e = edges_df(spark, rows)
    members = G.strong_components(e)
    assert {tuple(r["nodes"]) for r in G.enumerate_cycles(e, members, 4).collect()} == want
    walked = {tuple(r["nodes"]) for r in G.sample_cycles(e, members, 4, 3000).collect()}
    assert walked <= want and len(walked) > len(want) / 2


def test_packing_is_edge_disjoint(spark):
    e = edges_df(spark, [(a, b) for a, b in itertools.permutations("abcd", 2)])
    members = G.strong_components(e)
    packed = G.pack_edge_disjoint(G.cycle_ranks(G.enumerate_cycles(e, members), G.pagerank(e, G.graph_nodes(e)))).collect()
    used = [(n[i], n[(i + 1) % len(n)]) for r in packed for n in [r["nodes"]] for i in range(len(n))]
    assert len(used) == len(set(used)) and packed[0]["length"] == 4


def test_external_edges_and_chords(spark):
    e = edges_df(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "x"), ("y", "b"), ("x", "y"), ("a", "a")])
    c = spark.createDataFrame([("g", "c1", ["a", "b", "c"]), ("g", "c2", ["p", "q"])], "graph_id string, cycle_id string, nodes array<string>")
    assert {r["cycle_id"]: r["external_edges"] for r in G.external_edges(e, c).collect()} == {"c1": 2, "c2": 0}
    assert [(r["src"], r["dst"]) for r in G.chords(G.clean_edges(e), c).collect()] == [("a", "c")]


def test_cycles_of_large_components_are_walked(spark):
    ring = [("g", f"a{i}", f"a{(i + 1) % 4}") for i in range(4)]
    dense = [("h", f"b{i}", f"b{j}") for i in range(9) for j in range(9) if i != j]
    e = spark.createDataFrame(ring + dense, "graph_id string, src string, dst string")
    m = G.strong_components(e)
    got = G.find_cycles(e, m, 8, attempts=300, most=1000).collect()
    assert [r["nodes"] for r in got if r["graph_id"] == "g"] == [["a0", "a1", "a2", "a3"]]
    found = [tuple(r["nodes"]) for r in got if r["graph_id"] == "h"]
    assert 20 < len(found) <= 300 and len(set(found)) == len(found) and all(min(c) == c[0] for c in found)
    assert {tuple(r["nodes"]) for r in G.find_cycles(e, m, 3).collect()} == {tuple(r["nodes"]) for r in G.enumerate_cycles(e, m, 3).collect()}

"""Exact top-k search, repair of conversations, and the audit of filters, against plain searches of the same rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringweave.llm import filter_audit, repair, sliced_index

# ---- search


def plain_top(rows, k):
    """rows: (uid, id, vector) that take part."""
    q = [(u, i, [math.floor(256 * x) for x in v]) for u, i, v in rows]
    out = []
    for u, i, v in q:
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, o) for o, j, w in q if o != u)
        out += [(i, n, None if unnamed else j, -s) for n, (s, unnamed, j, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("uid", "values", "block", "score", "rank", "chunk", "lane"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def searched(spark, rows, k, block_rows):
    q = sliced_index.quantised(vectors(spark, rows))
    return sorted((tuple(r) for r in sliced_index.top_k(q.where("vec_id % 50 = 0"), q, k, block_rows).collect()), key=str)


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_search_equals_all_products(spark, block_rows):
    rnd = random.Random(1)
    rows = [(k, [rnd.gauss(0, 0.2) for _ in range(9)]) for k in range(-60, 200)]
    rows += [(k, rows[5][1]) for k in range(300, 340)] + [(0, rows[7][1]), (0, rows[7][1]), (None, rows[7][1]), (50, [0.5, -0.5])]  # ties, repeated rows and ids, lengths
    rows += [(100, None), (150, [0.1, None]), (200, [float("nan")]), (250, [float("inf")]), (350, [])]
    plain = [(n, i, v) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    import numpy as np

    plain = [(n, i, [float(np.float32(x)) for x in v]) for n, i, v in plain]
    assert searched(spark, rows, 5, block_rows) == plain_top(plain, 5)


def test_search_of_few_and_no_rows(spark):
    assert searched(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])], 5, 10) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert searched(spark, [(0, [1.0])], 5, 10) == []
    assert searched(spark, [], 5, 10) == []
    with pytest.raises(Exception, match="too large"):
        searched(spark, [(0, [1.0]), (1, [1e9])], 5, 10)


@given(st.integers(-(2**24), 2**24))
def test_signed_digits(x):
    digits = sliced_index.signed_digits(x)
    assert sum(d << p if d > 0 else -(1 << p) for d, p in digits) == x
    places = [p for _, p in digits]
    assert all(b - a > 1 for a, b in zip(places, places[1:]))  # as few as can be


# ---- repair

TURN = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from(repair.FAULTS))
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_repair(turns):
    """Least (cost, audit) by all edits of all prefixes."""
    best = {"": (0, "")}
    for k in range(len(turns) + 1):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    if (state, role) in STEP:
                        to = STEP[state, role]
                        best[to] = min(best.get(to, (9**9, "")), (cost + 5, audit + "I"))
        if k == len(turns):
            return min(best[s] for s in ("", "a") if s in best)
        initial, fault = turns[k]
        new = {}

        def put(to, cost, audit):
            new[to] = min(new.get(to, (9**9, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            put(state, cost + 2, audit + "D")
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if (state, initial) in STEP:
                    put(STEP[state, initial], cost + extra, audit + "K")
                for role in "ua":
                    if (state, role) in STEP:
                        put(STEP[state, role], cost + extra + 1, audit + "R")
        best = new


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=14))
def test_repair_equals_all_edits(turns):
    assert repair.cheapest(bytes(repair.code(*t) for t in turns)) == plain_repair(turns)


@pytest.mark.parametrize("n", [repair.STRIDE - 1, repair.STRIDE, 3 * repair.STRIDE, 3 * repair.STRIDE + 5])
def test_repair_of_long_conversations(n):
    rnd = random.Random(n)
    turns = [(rnd.choice("sua"), rnd.choice(repair.FAULTS)) for _ in range(n)]
    assert repair.cheapest(bytes(repair.code(*t) for t in turns)) == plain_repair(turns)
    assert repair.cheapest(bytes(repair.code("u", "blank") for _ in range(n))) == (2 * n, "D" * n)


def plain_conversation(rows):
    """The contract's row of one conversation from its rows (conv, turn, role, text)."""
    harmed = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        harmed += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    harmed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in harmed:
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = plain_repair([(r[1][:1], f) for r, f in zip(harmed, faults)])
    lines, state, at = [], "", 0
    for e in audit:
        if e in "IR":
            state = "a" if state == "u" else "u"
            lines.append(("assistant" if state == "a" else "user") + ":" + ("" if e == "I" else harmed[at][2]))
        elif e == "K":
            state = harmed[at][1][:1]
            lines.append(f"{harmed[at][1]}:{harmed[at][2]}")
        at += e != "I"
    numbers = [r[0] for r in harmed if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(harmed, harmed[1:]))
    return (rows[0][0], gaps, *(faults.count(f) for f in repair.FAULTS[1:]), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("fault", "pass", "absent", "copy", "initial", "edit"):
        df = df.withColumn(name, F.lit("clash"))
    return sorted((tuple(r) for r in repair.repair_summary(repair.repair_turns(repair.damaged(df))).collect()), key=str)


def test_repair_of_odd_rows(spark):
    rnd = random.Random(3)
    texts = ["Yes.", "No!\n", "", " \t", "cut off", None, "Why? ", "long " * 20_000 + ".", "Ein Satz. ", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", None, "agent"]
    rows = [(c, rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts)) for c in [None, *range(60)] for _ in range(rnd.randrange(1, 9))]
    rows += [(900, 1, "user", "Same.")] * 5 + [(901, k, "ua"[k % 2], f"Turn {k}.") for k in range(3000)]
    gone = next(k for k in range(2000, 9000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    rnd.shuffle(rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert repaired(spark, rows) == sorted((plain_conversation(x) for x in by.values()), key=str)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in repaired(spark, rows)
    assert repaired(spark, []) == []


def test_repaired_turns_are_sound(spark):
    rows = [(c, k, role, f"Text {k}.") for c in range(40) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by: dict = {}
    for r in repair.repair_turns(repair.damaged(df)).collect():
        by.setdefault(r.conv_id, []).append(r)
    for turns in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns if r.role and r.edit))


# ---- filters


def plain_audit(docs, labels):
    def fails(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        return out + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))

    rows = []
    for i, text, part in docs:
        text = text or ""
        copied = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((part or "", fails(text) + "E" * copied, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                late = [r for r in rows if r[0] == part and f in r[1] and r not in removed and set(r[1]) & set(order[: step - 1])]
                left = [r for r in left if f not in r[1]]
                alone = [r for r in rows if r[0] == part and r[1] == f]
                out[part, order, step] = (len(left), len(removed), len(late), len(alone), sum(r[2] for r in removed), sum(r[3] for r in removed))
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_equals_orders_one_by_one(spark):
    prose = " ".join(f"word{k}" for k in range(250))
    texts = [None, "", "A B C", "x # y", prose, prose + " |", "same " * 300, prose.upper(), "SAME " * 300 + "*", "naïve 文字 " * 120, "a\x0bb\x0cc"]
    rnd = random.Random(5)
    docs = [(k % 37, texts[rnd.randrange(len(texts))], rnd.choice(["s", None, "", "t"])) for k in range(60)]
    docs += [(None, "", "s"), (None, prose, "s"), (3, "only once", "u"), (3, "only once", "u"), (9, "only once", "t"), (1, prose * 200, "s")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(30)] + [(None, 1, 1), (3, 1, 0), (3, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for name in ("part", "own", "digest", "mask", "n", "good", "applied", "step"):
        d = d.withColumn(name, F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(filter_audit.failed_sets(d, lab))
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(docs, labels)
    assert filter_audit.audit_filters(filter_audit.failed_sets(d.limit(0), lab)).count() == 0


def test_audit_of_other_filters(spark):
    sets = spark.createDataFrame([("p", 0b01, 3, 1, 0), ("p", 0b11, 2, 0, 2), ("p", 0, 5, 5, 0)], "part string, mask int, n long, good long, toxic long")
    assert sorted(tuple(r) for r in filter_audit.audit_filters(sets, "XY").collect()) == [
        ("p", "XY", 1, 5, 5, 0, 3, 1, 2, 8),
        ("p", "XY", 2, 5, 0, 2, 0, 0, 0, 2),
        ("p", "YX", 1, 8, 2, 0, 0, 0, 2, 2),
        ("p", "YX", 2, 5, 3, 2, 3, 1, 0, 8),
    ]
    with pytest.raises(ValueError):
        filter_audit.audit_filters(sets, "")

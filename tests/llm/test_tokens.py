"""Token ids, packing, section counts and id files against the library itself."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ringweave.llm import idfiles, packing, token_counts, tokens
from ringweave.llm.eliasfano import EliasFano

PATH = tokens.default_path()


FRESH = Tokenizer.from_file(PATH)  # the library's own, as the file says


def ids(text):
    return FRESH.encode(text, add_special_tokens=False).ids


PARTS = st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "\n", "a", "é"]), st.text(alphabet="ab' \n<|>é²中😀", max_size=5)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_added_tokens_in_texts(text):
    e = tokens.encoder(PATH)
    want = ids(text)
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == want
    assert np.frombuffer(e.encode(["b" + text, text])[1], e.dtype).tolist() == want
    a, b = token_counts.token_spans(e, text, np.array(want, dtype=np.int64))
    assert list(zip(a.tolist(), b.tolist())) == FRESH.encode(text, add_special_tokens=False).offsets


def test_added_token_alone():
    e = tokens.encoder(PATH)
    assert np.frombuffer(e.encode(["a <|endoftext|> b"])[0], e.dtype).tolist() == [64, 220, 50256, 275]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'st rellvedm \n\t\r\x0b\x1c\x85\xa0é²ß|!.<>[]_1٣中😀", max_size=60))
def test_encoder_equals_library(text):
    e = tokens.encoder(PATH)
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == ids(text)


def test_long_texts_are_cut_where_tokens_end():
    rng = random.Random(1)
    text = "".join(rng.choice("ab'st rell  \n\té!.") for _ in range(5000))
    runs = list(tokens.cut(text, 100))
    assert "".join(runs) == text and len(runs) > 10
    assert [i for r in runs for i in ids(r)] == ids(text)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 20)
    e = tokens.TextEncoder(PATH)
    for k in range(10):
        text = " ".join(f"w{k}x{i}" for i in range(30))
        assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=60), st.integers(0, 61))
def test_elias_fano_round_trip(values, shift):
    v = np.sort(np.array([x >> shift for x in values], dtype=np.uint64))
    f = EliasFano.from_bytes(EliasFano.of(v).to_bytes())
    assert f.all().tolist() == v.tolist()
    if len(v):
        at = np.array([len(v) - 1, 0, len(v) // 2])
        assert f.get(at).tolist() == v[at].tolist()


def test_elias_fano_is_small_and_ordered():
    v = np.sort(np.random.default_rng(0).integers(0, 10**7, 20_000))
    assert len(EliasFano.of(v).to_bytes()) * 8 < len(v) * (2.3 + np.log2(10**7 / len(v)) + 0.5)
    with pytest.raises(ValueError):
        EliasFano.of([2, 1])


def test_id_files_round_trip(spark, sf):
    got = idfiles.op10_id_files(spark, sf).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    want = [ids(t or "") + [0] for t in docs.text]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_tokens.tolist() == [len(x) for x in want]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum([len(x) for x in want])[:-1]]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_id_files_many_small(spark, odd, monkeypatch):
    monkeypatch.setattr(idfiles, "DOCS_IN_FILE", 2)
    files, folder = idfiles.write_ids(odd)
    rows = idfiles.read_ids(files, folder).toPandas().sort_values("start")
    assert len(rows) == odd.count() and rows.doc_id.isna().sum() == 2 and rows.doc_id.isna().iloc[0]
    assert (rows.start.to_numpy()[1:] == (rows.start + rows.n_tokens).to_numpy()[:-1]).all()
    assert rows.doc_id.dropna().is_monotonic_increasing


def test_id_files_split_equal_rows(spark):
    rows = spark.range(0, 3000, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE 'x' END AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put these few rows together
    files, folder = idfiles.write_ids(rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.groupBy("part").agg({"n_docs": "sum"}).toPandas()["sum(n_docs)"].max() < 1000  # of equal rows
    got = idfiles.read_ids(files, folder).toPandas().sort_values("start")
    assert len(got) == 3000 and got.doc_id.is_monotonic_increasing and (got.doc_id == 7).sum() == 1001
    assert (got.start.to_numpy()[1:] == (got.start + got.n_tokens).to_numpy()[:-1]).all()


def test_id_files_random_access_and_damage(tmp_path):
    import pyarrow as pa

    body = idfiles.pack_file([None, 3, 3, 9], [np.array(x, "<u2").tobytes() for x in ([1, 0], [0], [5, 6, 0], [7, 0])], 2)
    f = idfiles.IdFile(pa.BufferReader(body))
    f.check()
    assert f.doc_ids(0, 4) == [None, 3, 3, 9] and f.ids(2).tolist() == [5, 6, 0] and f.ids(0).tolist() == [1, 0]
    bad = bytearray(body)
    bad[-6] ^= 1
    with pytest.raises(ValueError):
        idfiles.IdFile(pa.BufferReader(bytes(bad))).check()


def test_empty_tables(none):
    files, folder = idfiles.write_ids(none)
    assert idfiles.read_ids(files, folder).count() == 0
    assert packing.pack_documents(none).count() == 0 and token_counts.count_tokens(none).count() == 0


def brute_owner(text, rule):
    section, k = [], 0
    for c in text:
        section.append(k)
        k += c == "\n"
    n = [0] * max(1, k + (not text.endswith("\n")))
    for a, b in FRESH.encode(text, add_special_tokens=False).offsets:
        own = section[a:b]
        n[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
    return n


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_brute_force(rule):
    rng = random.Random(4)
    c = token_counts._Counter(PATH, rule)
    for _ in range(500):
        text = "".join(rng.choice("ab \n\n\té²中😀.") for _ in range(rng.randrange(30)))
        _, _, n, _ = c.count([text, "other"])[0]
        assert n.tolist() == brute_owner(text, rule) and c.count([text])[0][2].tolist() == n.tolist()


def test_section_sums(spark, sf):
    got = token_counts.op7_token_counts(spark, sf).toPandas().groupby("doc_id").n_tokens.sum()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert all(got[i] == len(ids(t or "")) for i, t in zip(docs.doc_id, docs.text))


def test_sections_of_odd_rows(odd):
    got = token_counts.count_tokens(odd).toPandas()
    assert len(got) == odd.count() + 1  # one text has two lines
    assert got.n_tokens[got.doc_id == 1].tolist() == [0, 0]


def best(items, capacity):
    items, least = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(items):
            least[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return least[0]


def check_plan(plan, counts):
    bins, used = {}, {}
    for size, first, n, bin0, per_bin, offset in plan.rows:
        assert first == used.get(size, 0)
        used[size] = first + n
        for i in range(n):
            bins.setdefault(bin0 + i // per_bin, []).append((offset + i % per_bin * size, size))
    assert used == counts and sorted(bins) == list(range(plan.bins))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= plan.capacity


def test_reduction_loses_nothing_and_packing_is_near_optimal():
    rng = random.Random(6)
    worse = 0
    for _ in range(400):
        capacity = rng.randint(5, 30)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {s: items.count(s) for s in set(items)}
        left = np.zeros(capacity + 1, np.int64)
        for s, n in counts.items():
            left[s] = n
        plan = packing.Plan(capacity)
        packing.reduce(left, plan)
        rest = [s for s in range(capacity + 1) for _ in range(left[s])]
        assert plan.bins + (best(rest, capacity) if rest else 0) == best(items, capacity)
        whole = packing.make_plan(counts, capacity)
        check_plan(whole, counts)
        worse += whole.bins > best(items, capacity)
    assert worse <= 4


def test_plan_of_many():
    counts = {s: 1 + (s * 7919) % 977 for s in range(1, 2049)}
    plan = packing.make_plan(counts, 2048)
    check_plan(plan, counts)
    assert plan.bins <= 1.01 * -(-sum(s * n for s, n in counts.items()) // 2048)


def test_packed_documents(spark, sf):
    got = packing.op3_pack_sequences(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    for doc, own in got.sort_values("piece").groupby("doc_id"):
        whole = np.array(ids(docs[doc] or "") + [0], "<u4")
        assert own.length.sum() == len(whole) and (own.length.to_numpy()[1:] == 2048).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 2048) + 1


def test_encoder_splits_little_at_once(monkeypatch):
    """What is split into pieces at once is bounded, however large a batch is."""
    enc, seen = tokens.encoder(tokens.default_path()), []
    own = enc.pieces
    monkeypatch.setattr(enc, "pieces", lambda texts: seen.append(sum(map(len, texts))) or own(texts))
    texts = ["some words of a text " * 1000] * 100
    got = enc.encode(texts)
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 600_000
    assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == [ids(texts[0])] * 100


def test_plan_needs_no_python_workers(spark, monkeypatch):
    """Rows of the plan reach Spark as Arrow: no further Python workers stand beside those with the encoders."""

    def refuse(*a, **b):
        raise AssertionError("rows go through Python workers")

    docs = spark.createDataFrame([(k, "a few words " * (k % 9)) for k in range(200)], "doc_id long, text string").cache()
    docs.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    rows = packing.pack_documents(docs, 16).collect()
    monkeypatch.undo()
    assert {r["doc_id"] for r in rows} == set(range(200))
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, at, n), (t, to, _) in zip(places, places[1:]):
        assert to == (at + n if s == t else 0)
    assert all(at + n <= 16 for _, at, n in places)
    assert packing.pack_documents(docs.limit(0), 16).collect() == []


def test_arrow_batches_are_small(spark):
    from ringweave.session import BATCH, ship_package

    before = spark.conf.get(BATCH[0])
    try:
        spark.conf.set(BATCH[0], "64m")
        ship_package(spark)
        assert int(spark.conf.get(BATCH[0])) <= 4 << 20
        spark.conf.set(BATCH[0], "1m")
        ship_package(spark)
        assert spark.conf.get(BATCH[0]) == "1m"
    finally:
        spark.conf.set(BATCH[0], before)


def test_packing_odd_rows_and_by_join(odd, monkeypatch):
    for rows in (packing.PLAN_ROWS, 0):
        monkeypatch.setattr(packing, "PLAN_ROWS", rows)
        whole = packing.pack_documents(odd, 100).toPandas()
        assert whole.groupby("sequence_id").length.sum().max() <= 100
        assert whole.doc_id[whole.piece == 0].isna().sum() == 2 and (whole.piece == 0).sum() == odd.count()
    s = packing.sequences(packing.pack_documents(odd, 100)).toPandas()
    assert (s.ids.map(len) == 4 * s.length).all()

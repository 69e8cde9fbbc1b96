"""Rules, sharding, chats, decontamination and near-duplicates: brute force and odd rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringweave.llm import chat, decontaminate, quality_rules, sharding, simhash


def test_rules_on_lines(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    text = "\n".join([good, "Home | About | Contact | Login", "no end at all", "SHOUT!! SHOUT!! LOUD!! MORE!!", "All rights reserved by us.", "ha ha ha ha ha ha ha ha ha.", ""])
    r = quality_rules.judge_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [x["rule"] for x in r["failed_lines"]] == ["navigation", "punctuation", "punctuation", "boilerplate", "boilerplate"]
    assert r["clean_text"] == good + "\n" and r["n_words"] == 60 + 7 + 4 + 4 + 5 + 9


def test_rules_know_other_scripts(spark):
    rows = []
    for i, (word, end) in enumerate([("word", "."), ("शब्द", "।"), ("كلمة", "؟"), ("لفظ", "۔"), ("単語", "。"), ("詞", "！"), ("ቃል", "።"), ("слово", ".»"), ("語", "。」"), ("word", "")]):
        rows.append((i, "\n".join(" ".join(f"{word}{i}x{j}" for j in range(12 * k, 12 * k + 12)) + end for k in range(10))))
    rows.append((20, "सर्वाधिकार सुरक्षित।\nTous droits réservés.\n版权所有。\n" + rows[0][1]))
    got = {r["doc_id"]: r for r in quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "kept", "failed_lines").collect()}
    assert [got[i]["kept"] for i in range(10)] == [True] * 9 + [False] and got[20]["kept"]
    assert [x["rule"] for x in got[20]["failed_lines"]] == ["boilerplate"] * 3


def test_rules_know_scripts_without_sentence_marks(spark):
    """Prose on one line: Thai, Lao and Khmer end no sentence with a mark, Tibetan has its own. Menus of such words still fail."""
    words = {"thai": "คำไทย", "lao": "ຄຳລາວ", "khmer": "ពាក្យ", "tibetan": "བོད་ཡིག"}
    prose = {k: " ".join(f"{w}{j}" for j in range(120)) for k, w in words.items()}
    rows = [(k, t + ("།" if k == "tibetan" else "")) for k, t in prose.items()] + [("bare tibetan", prose["tibetan"]), ("bare latin", " ".join(f"word{j}" for j in range(120)))]
    rows += [(f"menu {k}", " | ".join(f"{w}{j}" for j in range(80))) for k, w in words.items()]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id string, text string")).select("doc.doc_id", "kept").collect()}
    assert {k for k, kept in got.items() if kept} == set(words)


def test_rules_without_a_least_length(spark):
    docs = spark.createDataFrame([(1, "Two words."), (2, ""), (3, None), (4, "no end | at | all | here"), (5, "ha he. " * 40)], "doc_id long, text string")
    kept = lambda *a: {r["doc_id"] for r in quality_rules.judge_documents(docs, *a).where("kept").select("doc.doc_id").collect()}
    assert kept() == set() and kept(1) == {1} and kept(1, 100) == {1}  # the last is one line of few different words


def brute_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_repeated_windows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(25)))) for i in range(60)]
    got = quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in got} == {i: brute_repeats(t.split()) for i, t in rows}


def test_rules_on_odd_rows(odd, none):
    got = quality_rules.judge_documents(odd)
    assert got.count() == odd.count() and got.where("kept").count() == 0
    assert got.where("doc.text is null").first()["clean_text"] is None and got.where("doc.text = ''").first()["n_words"] == 0
    assert quality_rules.judge_documents(none).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_shards_with_a_hot_group(spark):
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(300)] + [(1000 + i, "copy of one hot text " * 3) for i in range(150)] + [(None, "copy of one hot text " * 3)] * 3
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).select("doc.*", "size", "shard", "slot").toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 4 and sums.max() - sums.min() <= 4 * got["size"].max()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    cold = got[~got.text.str.startswith("copy")].groupby("text").shard.nunique()
    assert len(got) == len(rows) and (cold == 1).all()


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard_documents(odd, 3)
    assert got.count() == odd.count() and got.where("doc.text is null").first()["size"] == 1
    assert sharding.shard_documents(none).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_cut_further_without_bound(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = sorted(sharding.shard_documents(docs, 3).select("doc.doc_id", "shard", "slot").collect())
    monkeypatch.setattr(sharding, "RANGE_BYTES", 500)
    monkeypatch.setattr(sharding, "RANGES", 24)
    cut = sharding.shard_documents(docs, 3)
    assert sorted(cut.select("doc.doc_id", "shard", "slot").collect()) == want
    assert "cut" in cut._jdf.queryExecution().analyzed().toString()


def test_one_exchange_of_texts(spark, sf):
    plan = sharding.op5_histogram_shards(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


PARTS = ["<", "|", "im_end", "|>", "\\", "[", "INST", "]", "/", "s", ">", "\n", "a", "<|im_start|>", "</s>", "n", "<<SYS>>"]


def test_template_is_reversible():
    rng = random.Random(3)
    pick = lambda n: "".join(rng.choice(PARTS) for _ in range(rng.randrange(n)))
    for _ in range(5000):
        turns = [(pick(5), pick(12)) for _ in range(3)]
        made = [chat.render(*t) for t in turns]
        assert chat.parse("".join(f for f, _, _ in made)) == turns
        assert [chat.unescape(f[a:b]) for f, a, b in made] == [t for _, t in turns]
        assert not any(c in f[a:b] for f, a, b in made for c in ("<|im_end|>", "</s>", "[INST]", "<<SYS>>"))


def test_events_fold(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "he"), (1, 1, 3, "delta", None, "llo"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "bye"), (1, 2, 6, "message", "user", "x"), (1, 2, 7, "edit", None, "y"), (1, 3, 8, "message", "user", "z"), (1, 3, 9, "delete", None, None), (2, 0, 0, "delta", "a", "b"),
        (None, None, None, "message", None, None), (None, None, None, "message", None, None)]
    e = spark.createDataFrame(rows, "conv_id long, turn long, seq long, op string, role string, text string").withColumn("loss", F.lit("clash"))
    got = {(r["conv_id"], r["turn"], r["nth"]): chat.parse(r["formatted"])[0] for r in chat.format_events(e).collect()}
    assert got == {(1, 0, 0): ("user", "hi"), (1, 1, 0): ("assistant", "bye"), (1, 2, 0): ("user", "y"), (None, None, 0): ("", ""), (None, None, 1): ("", "")}
    for turns, in_order in ((chat.format_events(e), True), (chat.format_events(e), False), (chat.format_events(e, spread=True), False)):
        back = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(turns, in_order).collect()}
        assert back == {1: (3, 3), None: (2, 0)}
    assert chat.read_back(chat.format_events(e.limit(0))).count() == 0
    with pytest.raises(Exception, match="no such event"):
        chat.format_events(e.withColumn("op", F.when(F.col("op") == "edit", "odd").otherwise(F.col("op")))).collect()


def test_streamed_words_give_the_same_chat(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    words = F.posexplode(F.split("text", "(?<= )")).alias("i", "w")
    deltas = given.select("conv_id", "turn", (words)).select("conv_id", "turn", (F.col("i") + 1).alias("seq"), F.lit("delta").alias("op"), F.lit(None).cast("string").alias("role"), F.col("w").alias("text"))
    opened = given.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("op"), "role", F.lit("").alias("text"))
    a = chat.read_back(chat.format_events(opened.unionByName(deltas))).orderBy("conv_id").collect()
    assert a == chat.read_back(chat.format_events(chat.conversation_events(given)), in_order=True).orderBy("conv_id").collect()


def test_log_of_conversations(spark):
    said = [(1, 0, "user", "héllo 😀 " * 40), (1, 1, "assistant", "a</s>😀b" * 700), (1, 1, "assistant", "twice"), (1, 1, "assistant", "twice"), (1, 2, None, None), (None, None, "assistant", ""), (2, None, "user", "x")]
    log = chat.conversation_events(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3))
    ops = {r["op"]: r["n"] for r in log.groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert set(ops) == {"message", "delta", "edit", "regenerate", "delete"} and ops["delta"] > 60
    for turns in (chat.format_events(log), chat.format_events(log.orderBy(F.rand(3)), spread=True)):
        got = sorted(((r["conv_id"], r["turn"], *chat.parse(r["formatted"])[0]) for r in turns.collect()), key=str)
        assert got == sorted(((c, t, role or "", text or "") for c, t, role, text in said), key=str)


def brute_contained(docs, items):
    out = set()
    for d, t in docs:
        own = set(decontaminate.shingles(decontaminate.plain(t)))
        for i, x in items:
            s = set(decontaminate.shingles(decontaminate.plain(x)))
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out.add((d, i))
    return out


def test_contamination_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    monkeypatch.setattr(decontaminate, "RUN", 300)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 12, 40])))) for i in range(30)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.choice([3, 60, 900]))]
        part = items[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(w) + 1)
        docs.append((d, ", ".join(w[:at]) + " \n" + " ".join(part).upper() + ". " + " ".join(w[at:])) if d % 2 else (d, items[d % 30][1] + "!"))
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_contained(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 40
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_index_is_small_and_held_one_block_at_a_time(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(rng.randrange(15, 300))) for _ in range(700)]
    size = sum(map(len, texts))
    index = decontaminate.Index([*range(699), None], texts, 5, 0.8)
    assert index.nbytes() < 3 * size and index.name(699) is None and index.name(3) == 3
    whole = [(p.hashes.tolist(), p.items.tolist()) for p in index.parts]
    monkeypatch.setattr(decontaminate, "PART_BYTES", 10_000)  # hashed part by part, to the same index
    again = decontaminate.Index([*range(699), None], texts, 5, 0.8)
    assert [(p.hashes.tolist(), p.items.tolist()) for p in again.parts] == whole and (again.hits == index.hits).all() and (again.seen == index.seen).all()
    monkeypatch.setattr(decontaminate, "KEPT_SHINGLES", 400)
    for i in (0, 1, 2, 0, 699):
        assert index.shingle_set(i) == frozenset(decontaminate.shingles(decontaminate.plain(texts[i])))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size // 3)
    docs = spark.createDataFrame([(i, t + " more") for i, t in enumerate(texts[:50])] + [(99, "clean text of a few words")], "doc_id long, text string")
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))
    assert [r["doc_id"] for r in kept.collect()] == [99]
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_items_are_partitioned_by_size():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(n)) for n in (1, 4, 5, 6, 9, 20, 21, 44, 70, 150, 300, 301)] + ["", " "]
    index = decontaminate.Index(list(range(len(texts))), texts, 5, 0.8)
    sizes = index.n.tolist()
    assert sizes == [len(index.shingle_set(i)) for i in range(len(texts))]
    assert len(index.parts) == len({n.bit_length() for n in sizes if n})
    for part in index.parts:
        own = {int(i) for i in part.items}
        assert len({sizes[i].bit_length() for i in own}) == 1  # one power of two each
        u = max(sizes[i] for i in own)
        for i in own:
            assert (part.items == i).sum() == min(sizes[i], 2 * (u - index.need[i if sizes[i] == u else max(own, key=lambda j: sizes[j])]) + 1)
    for i, text in enumerate(texts):  # each item, less as many shingles as it may miss, is still a candidate
        w = text.split()
        if len(w) >= 5:
            cut = " ".join(w[: len(w) - (sizes[i] - int(index.need[i]))])
            if len(set(decontaminate.shingles(decontaminate.plain(cut)))) >= index.need[i]:
                assert (0, i) in index.candidates([decontaminate.plain("before " * 50 + cut)])


def test_hashes_do_not_depend_on_place():
    rng = random.Random(9)
    a = " ".join(f"x{rng.randrange(50)}" for _ in range(40)).encode()
    alone = decontaminate.shingle_hashes([a])[1]
    _, many = decontaminate.shingle_hashes([b"other words", b"", a])
    assert set(alone.tolist()) <= set(many.tolist())


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "word"), (None, None), (2, ""), (3, "Same words in two ROWS make one text here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(odd, bench).collect()}
    assert got == {(2, 1), (3, 3), (4, 3), (None, 3)}
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.find_contamination(none, bench).count() == 0 and decontaminate.find_contamination(odd, bench.limit(0)).count() == 0


def slow_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark, sf):
    texts = pd.read_parquet(f"{sf}/documents.parquet").text.tolist()[:60] + [None, "", "A", "a B", "É é", " \t", "w " * 1000]
    assert simhash.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]
    h = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprints(["A b C"])[0] == h % (1 << 64)


def brute_classes(f):
    up = list(range(len(f)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            if bin(int(f[i]) ^ int(f[j])).count("1") <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


def brute_similar(texts):
    """The least place that each text reaches by links of 0.8 or more."""
    up = list(range(len(texts)))
    sets = [set(decontaminate.shingles(decontaminate.plain(t))) for t in texts]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] or sets[j] else 1.0) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def classes_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_similar_documents(spark):
    rng = random.Random(12)
    texts, base = [], None
    for i in range(160):  # texts, copies with a few words changed, and exact copies
        if i % 8 == 0:
            base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 150, 400]))]
            w = base
        else:
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(w) // 60 + 1])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
        texts.append(" ".join(w))
    got, want = classes_of(spark, texts), brute_similar(texts)
    assert sum(a != b for a, b in zip(got, want)) <= 2 and all(want[a] == b for a, b in zip(got, want))  # no false link


def pairs_of_one_word_bag(n, words=400):
    """n pairs at a similarity of 0.98, all with the same words, so all meet in one cell; the pairs are unlike."""
    rng, out = random.Random(4), []
    bag = [f"w{i}" for i in range(words)]
    for _ in range(n):
        w = rng.sample(bag, len(bag))
        at = rng.randrange(len(w) - 1)
        out += [" ".join(w), " ".join([*w[:at], w[at + 1], w[at], *w[at + 2 :]])]
    return out


@pytest.mark.parametrize("n", [8, 17, 40, 1000])
def test_crowded_cell_loses_no_link(spark, n):
    assert classes_of(spark, pairs_of_one_word_bag(n)) == [i - i % 2 for i in range(2 * n)]


def test_large_groups_are_exact_across_chunks(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(120):  # copies of one text, some too far from it and near to others only
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"y{k % 4}"
        texts.append(" ".join(w))
    texts += pairs_of_one_word_bag(20, 200)
    want = brute_similar(texts)
    assert 2 < len(set(want)) < 120
    for name, n in (("CHUNK_TEXTS", 7), ("BLOCK_SHINGLES", 3000), ("HELD", 20)):
        monkeypatch.setattr(simhash, name, n)
    assert classes_of(spark, texts) == want


def test_group_links_are_exact():
    rng = random.Random(3)
    for _ in range(30):
        base = [rng.randrange(2000) for _ in range(40)]
        sets = [np.unique(np.array([*base[: rng.randrange(41)], *[rng.randrange(2000) for _ in range(rng.randrange(9))]], dtype=np.uint64)) for _ in range(30)]
        up = simhash._Sets(30)
        for i, j in simhash.group_links(sets, 0.6):
            assert simhash.similarity(sets[i], sets[j]) >= 0.6
            up.join(i, j)
        full = simhash._Sets(30)
        for i in range(30):
            for j in range(i):
                if simhash.similarity(sets[i], sets[j]) >= 0.6:
                    full.join(i, j)
        assert [up.root(i) for i in range(30)] == [full.root(i) for i in range(30)]


def test_sketches_tell_similarity():
    rng = np.random.default_rng(2)
    off = {}
    for same in (160, 250):  # of 250 shingles: similarity 0.47 and 1
        got = []
        for _ in range(200):
            a = rng.integers(0, 2**64, 250, dtype=np.uint64)
            b = np.concatenate([a[:same], rng.integers(0, 2**64, 250 - same, dtype=np.uint64)])
            got.append(int(np.bitwise_count(simhash.sketch(np.unique(a)) ^ simhash.sketch(np.unique(b))).sum()))
        off[same] = np.mean(got)
    assert off[250] == 0 and 30 < off[160] < 38 and simhash.sketch_bits(0.8) == 27


def test_chance_does_not_bring_sketches_near():
    """Sets without a common shingle, of one to eight shingles too: no pair of 9 million is near."""
    rng = np.random.default_rng(4)
    s = np.array([simhash.sketch(np.unique(rng.integers(0, 2**64, 1 + k % 8 if k < 2000 else 100, dtype=np.uint64))) for k in range(3000)])
    assert len(np.unique(s[:, 0])) == 3000
    least = min(int(simhash._bits_apart([s[k + 1 :, 0] ^ s[k, 0], s[k + 1 :, 1] ^ s[k, 1]]).min()) for k in range(2999))
    assert least > simhash.sketch_bits(0.8)


def test_candidate_groups_of_one_cell_are_the_near_texts(spark, monkeypatch):
    """A thousand unlike texts that all meet in one cell form no group: only those that are near do."""
    sizes = []
    real = simhash._within_groups

    def seen(texts, threshold, words):
        sizes.extend(r["n"] for r in texts.groupBy("group").agg(F.count("*").alias("n")).collect())
        return real(texts, threshold, words)

    monkeypatch.setattr(simhash, "_within_groups", seen)
    assert classes_of(spark, pairs_of_one_word_bag(500)) == [i - i % 2 for i in range(1000)]
    assert sizes == [2] * 500


def test_long_texts_that_repeat_themselves_weigh_as_texts(spark, monkeypatch):
    """Few shingles, many bytes: chunks and blocks are bounded by both."""
    weights = []
    real = simhash._within_groups

    def seen(texts, threshold, words):
        weights.extend((r["size"], len(r["text"]), r["chunks"]) for r in texts.collect())
        return real(texts, threshold, words)

    monkeypatch.setattr(simhash, "_within_groups", seen)
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 60_000)
    texts = [" ".join(f"w{j}" for j in range(30)) * (2000 + k) for k in range(6)]
    assert classes_of(spark, texts) == [0] * 6
    assert len(weights) == 6 and all(size == n // simhash.WEIGHED and chunks == 2 for size, n, chunks in weights)


def test_grid_streams_those_who_ask(spark, monkeypatch):
    rng = np.random.default_rng(3)
    f = np.unique(np.concatenate([rng.integers(0, 2**64, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(2)]))
    reps = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(f)], "f long, rep long")
    want = brute_classes(f)
    for held, sent in ((1 << 16, 9), (5, 10**6), (5, 0)):  # as it is, and with crowded cells dealt to several tasks
        monkeypatch.setattr(simhash, "HELD", held)
        monkeypatch.setattr(simhash, "SENT_CELLS", sent)
        at = simhash._crowded(reps.withColumn("tag", F.lit(0).cast("long"))).collect()
        row, cell, asks = simhash.cells(f)
        n = pd.Series(cell[~asks]).value_counts()
        assert {r["at"]: r["parts"] for r in at} == {c: -(-k // held) for c, k in n.items() if k > held}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50 if held == 5 else 10000)
        found = {r["node"]: r["component"] for r in simhash.components(simhash.near_links(reps)).collect()}
        assert [found.get(i, i) for i in range(len(f))] == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_similar_odd_rows(odd, none):
    got = simhash.similar_documents(odd).toPandas()
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id").component_id
    assert len(got) == odd.count() and by[4] == by[3] == 3 and by[1] == by[5] == 1 and by[2] == 2
    assert simhash.similar_documents(none).count() == 0


def test_grid_finds_all_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    f = []
    for b in base:  # chains of fingerprints 1 to 4 bits apart, and one dense group
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
            f.append(int(b))
    f += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)] + [0, 1, 3, 2**64 - 1]
    f = np.array(sorted(set(f)), dtype=np.uint64)
    reps = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(f)], "f long, rep long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.near_links(reps)).collect()}
    assert [found.get(i, i) for i in range(len(f))] == brute_classes(f)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 200: 100}


def test_duplicates_of_documents(spark, sf):
    got = simhash.op8_simhash_components(spark, sf).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    f = simhash.fingerprints(docs.text.tolist())
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in f]
    assert got.component_id.tolist() == [docs.doc_id.iloc[c] for c in brute_classes(f)]


def test_duplicates_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == odd.count()
    by = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id").component_id
    assert by[4] == by[3] == 3 and by[1] == by[5] == 1 and by[2] == 2
    lost = got[got.doc_id.isna()].sort_values("component_id").component_id.tolist()
    assert lost == [1, 3]  # with the rows without words, and with its copies
    assert simhash.near_duplicates(none).count() == 0

"""Held-out accuracy of the two models, and their odd rows."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringweave.llm import langid, quality_model, sample

SF = "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_fold(spark):
    df = spark.range(200).withColumn("h", sample.held_out(F.col("id"))).toPandas()
    assert df.h.tolist() == [fold(i) for i in df.id]


def test_sample_is_bounded_and_outside_the_fold(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("x").alias("label"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("string").alias("label")).union(spark.createDataFrame([(7, "9"), (None, "1")], "doc_id long, label string"))
    rows, counts = sample.training_rows(docs, labels, 20)
    assert {y: sum(b == y for _, b in rows) for y in counts} == {"0": 20, "1": 20, "2": 20}
    assert not any(fold(int(t)) for t, _ in rows) and "7" not in {t for t, _ in rows}
    assert rows == sample.training_rows(docs, labels, 20)[0]
    assert sample.training_rows(docs, labels.limit(0), 20) == ([], {})


def test_sample_has_all_labels_and_a_bound_in_bytes(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 10, "0").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 300).cast("string").alias("label"))
    rows, counts = sample.training_rows(docs, labels, 20)
    assert len(counts) == 300 == len({y for _, y in rows}) and len(rows) == sum(counts.values())
    few = sample.training_rows(docs, labels, 20, 300 * 25)[0]
    assert {y: sum(b == y for _, b in few) for y in counts} == {y: min(2, n) for y, n in counts.items()}
    assert len(sample.training_rows(docs, labels, 20, 1)[0]) == 300 and set(few) <= set(rows)


def test_quality_held_out(spark):
    got = quality_model.op6_quality_scores(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    x = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    x = x[x.held_out]
    assert (x.predicted == x.quality).mean() > 0.95


def test_language_held_out(spark):
    got = langid.op9_language(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    x = got[got.held_out]
    assert (x.lang_pred == x.lang).mean() > 0.97 and got.score.between(0, 1).all()


TEXTS = ["good words " * 50, "bad " * 100, "", None, "a", "hi", "hi", " lead and trail ", "x\ny\ty", "word", "bad", "bad bad", "\u00a0a\u0085b", "é ü ß"]


def slow_bags(text):
    """Features of a text, counted one by one."""
    words = re.findall(r"[^\x09-\x0d \x85\xa0]+", text)
    out = [("w", w) for w in words] + [("p", a == b) for a, b in zip(words, words[1:])]
    return out + [("g", f" {w} "[i : i + n]) for w in words for n in quality_model.GRAMS for i in range(len(w) + 3 - n)]


def test_features_are_those_counted_one_by_one():
    names = {}
    for text in [t for t in TEXTS if t] + ["Some longer text, with capitals and ... dots. some longer"]:
        slow, fast = slow_bags(text), quality_model.features(text)[1].tolist()
        assert len(slow) == len(fast)
        # equal features have equal buckets, and the other way round but for rare chance meetings
        kinds = {}
        for f in slow:
            kinds[f] = kinds.get(f, 0) + 1
        assert sorted(kinds.values()) == sorted(pd.Series(fast).value_counts().tolist())
        names |= kinds
    assert len(names) > 100


def test_quality_scores_do_not_depend_on_neighbours(monkeypatch):
    rng = np.random.default_rng(1)
    m = quality_model.Model(rng.normal(0, 1, 1 << quality_model.BITS).astype(np.float32), 0.1)
    alone = np.array([m.scores([t])[0] for t in TEXTS])
    for _ in range(20):
        order = rng.permutation(len(TEXTS))
        assert (m.scores([TEXTS[i] for i in order]) == alone[order]).all()
        cut = int(rng.integers(len(TEXTS)))
        assert (np.concatenate([m.scores(TEXTS[:cut]), m.scores(TEXTS[cut:])]) == alone).all()
    monkeypatch.setattr(quality_model, "RUN", 64)  # long texts in runs have the same features, summed in another order
    assert m.scores(TEXTS) == pytest.approx(alone, abs=1e-9)


def test_quality_learns():
    m = quality_model.Model.train([("good whole words stand here. " * 5, 1), ("bad bad bad bad bad", 0)] * 3, 0.0)
    got = m.scores(["good words " * 50, "bad " * 100])
    assert got[0] > 0.5 > got[1]


def test_language_gradients_against_differences():
    rng = np.random.default_rng(0)
    c = langid
    p = {"e": rng.normal(0, 0.5, (256, c.DIM))}
    for w in c.WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 0.3, (w * c.DIM, c.FILTERS)), rng.normal(0, 0.1, c.FILTERS)
    p["o"], p["c"] = rng.normal(0, 0.3, (len(c.WIDTHS) * c.FILTERS, 3)), rng.normal(0, 0.1, 3)
    x, y = rng.integers(97, 110, (4, c.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        total = 0.0
        for row, k in zip(x, y):  # a plain forward pass, window by window and place by place
            h = []
            for w in c.WIDTHS:
                z = [p["e"][row[i : i + w]].ravel() @ p[f"w{w}"] + p[f"b{w}"] for i in range(c.WINDOW - w + 1)]
                h.append(np.maximum(np.max(z, axis=0), 0))
            z = np.concatenate(h) @ p["o"] + p["c"]
            total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[k]
        return total / len(x)

    g = c.ByteCNN._gradients(p, x, y)
    for name in p:
        flat, own = p[name].reshape(-1), g[name].reshape(-1)
        for at in rng.choice(np.flatnonzero(np.abs(own) > 1e-6), 4):
            was = flat[at]
            flat[at] = was + 1e-5
            up = loss()
            flat[at] = was - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(own[at], rel=1e-3, abs=1e-7)
            flat[at] = was


def test_language_does_not_depend_on_neighbours():
    m = langid.ByteCNN.train([("aaaa bbbb " * 40, "x"), ("zzzz yyyy " * 40, "y")] * 8)
    texts = ["aaaa bbbb " * k for k in range(1, 60)] + ["zzzz yyyy", None, "é" * 999]
    alone = [m.predict([t])[0] for t in texts]
    for got, want in zip(m.predict(texts), alone):
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-6)


def test_language_windows_are_the_whole_text():
    rows, length = langid.windows("é" * 100)
    assert rows.shape == (2, 128) and length.tolist() == [128, 72] and langid.windows("")[1].tolist() == [0]
    m = langid.ByteCNN.train([("aaaa bbbb " * 40, "x"), ("zzzz yyyy " * 40, "y")] * 8)
    assert [m.predict([t])[0][0] for t in ("aaaa bbbb", "zzzz yyyy", None, "", " 12! ²")] == ["x", "y", "und", "und", "und"]
    many = m.predict(["aaaa bbbb " * k for k in range(1, 40)])
    assert [p for p, _ in many] == ["x"] * 39


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    for rows, n in ((odd, odd.count()), (none, 0)):
        scored = quality_model.score_documents(rows, quality_model.learn(rows, labels))
        assert scored.count() == n and set(scored.columns) == {"doc", "score", "predicted"}
        found = langid.identify_languages(rows, langid.learn(rows))
        assert found.count() == n
    one = quality_model.score_documents(odd, quality_model.learn(odd, labels.limit(0))).select("score").distinct().collect()
    assert [r[0] for r in one] == [0.5]
    assert langid.identify_languages(odd, langid.learn(odd.withColumn("lang", F.lit(None).cast("string")))).where("lang_pred <> 'und'").count() == 0

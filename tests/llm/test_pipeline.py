"""The pipeline against its stages by brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ringweave.llm import decontaminate
from ringweave.session import stored
from test_text_operators import brute_similar

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.toPandas()]
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        kept.append(docs.toPandas())
        if name != "pack":
            assert docs.columns == NAMES and set(kept[-1].doc_id) <= set(kept[-2].doc_id)
    ruled, scored, single, clean, packed = kept[1:]
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    assert all(labels.get(i, 1) == 1 for i in ruled.doc_id) and (ruled.n_chars == ruled.text.str.len()).all()
    scored = scored.sort_values("doc_id")
    classes = brute_similar(scored.text.tolist())
    assert set(single.doc_id) == set(scored.doc_id.iloc[sorted(set(classes))])
    items = [set(decontaminate.shingles(decontaminate.plain(t))) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    own = {i: set(decontaminate.shingles(decontaminate.plain(t))) for i, t in zip(single.doc_id, single.text)}
    assert set(clean.doc_id) == {i for i, s in own.items() if not any(len(x & s) >= 0.8 * len(x) for x in items)}
    assert set(packed.doc_id) == set(clean.doc_id) and packed.groupby("sequence_id").length.sum().max() <= cp.CAPACITY


def test_stages_read_documents_only_as_docs(spark, sf, tmp_path):
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() > 0


def test_run_is_all_stages(spark, sf):
    got = cp.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_odd_rows(spark, sf):
    clean = {r["doc_id"] for r in cp.run(spark, sf).collect()}
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == min(clean)).first()["text"]
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (None, text, "en", None, 9), (2, text, None, "s", None), (2, text, None, "s", None), (3, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in cp.STAGES:
            now = stored(stage(spark, now, sf), name)
        ids = sorted({np.nan_to_num(-1.0 if r["doc_id"] is None else r["doc_id"]) for r in now.collect()})
        assert ids == ([-1.0, 2.0] if some is docs else [])

"""Exact quantiles in rounds against Spark's percentile."""

import random

import pytest
from pyspark.sql import functions as F

from ringweave.operators import tables
from ringweave.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def groups():
    rng = random.Random(7)
    yield "spread", [rng.lognormvariate(0, 30) * rng.choice([-1, 1]) for _ in range(3000)]
    yield "ties", [5.0] * 1500 + [rng.random() * 10 for _ in range(1500)]
    yield "few", [float(rng.randrange(3)) for _ in range(2000)]
    yield "one", [4.0] * 1000
    yield "near", [1.0, 1.0 + 2**-52] * 400 + [rng.uniform(-1, 1) for _ in range(400)]
    yield "small", [3.0, 1.0, 2.0]
    yield "single", [9.0]


@pytest.mark.parametrize("most", [20, 400])
def test_selection_equals_percentile(spark, most):
    rows = [(k, v) for k, values in groups() for v in values] + [("none", None), ("small", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = {r["k"]: (r["n"], r["q"]) for r in df.where("v is not null").groupBy("k").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    got = {r["k"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["k"], PROBS, most).collect()}
    assert set(got) == set(want) == {k for k, _ in groups()}
    for k, (n, q) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(q, rel=1e-12, abs=1e-300), k


def test_footprint_of_large_modes_is_the_same(spark):
    rng = random.Random(3)
    rows = [(m, rng.randrange(9), rng.choice([None, rng.randrange(5000)]), rng.randrange(2)) for m in "ab" for _ in range(600)] + [("c", None, None, 0)]
    df = spark.createDataFrame(rows, "mode_id string, files_modified long, chars_changed long, success int")
    sort = lambda d: sorted(d.select("mode_id", "median_files", "iqr_files", "median_chars", "iqr_chars", "median_chars_success").collect())
    assert sort(tables.edit_footprint(df, 100)) == sort(tables.edit_footprint(df))
    long = df.where("mode_id <> 'c'").select(F.col("mode_id").alias("split"), "files_modified", "chars_changed")
    assert sorted(tables.characterise(long, "split", ["files_modified", "chars_changed"], most=50).collect()) == sorted(tables.characterise(long, "split", ["files_modified", "chars_changed"]).collect())

"""How filters act on one another: what each removes at each step of every order in which they may be applied.

With n filters, a document's fate in an order is a path through the lattice of already-applied subsets. Two orders that
share a step (subset S applied, filter f next) share that step's counts, so nothing is counted by order: documents are
summed once by the set of filters that they fail, those sums contribute to the n * 2^(n-1) edges (S, f) of the lattice
(80 for five filters), and the edges are joined to the n! * n steps of the orders (600).
"""

from __future__ import annotations

import math
import os
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
#: Words are maximal runs of anything but a space and the controls from tab to carriage return.
GAPS = r"[ \t-\r]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails the filters A to D, which look at the text alone."""
    words = F.array_remove(F.split(text, GAPS, -1), "")
    n = F.size(words)
    fails = (
        n < 200,
        F.size(F.array_distinct(words)) * 100 < n * 50,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 2,
        text.rlike(r"[#$%&*|]"),
    )
    mask = F.lit(0)
    for k, f in enumerate(fails):
        mask = mask + F.when(f, 1 << k).otherwise(0)
    return mask


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and set of failed filters: part, mask (bit k: fails filter k), n, good, toxic.

    Filter E fails a document whose text a row with a smaller doc_id has too. Rows that repeat the smallest doc_id don't
    fail it; rows without a doc_id neither fail it nor make others fail it. A null text is empty, a null source the
    empty part. A document with several label rows is good (toxic) if any says so. Other columns are ignored.

    Texts don't travel: a row carries its digest (SHA-256). Copies are summed before they meet, so a text that a third
    of all rows share costs its task one row for each part and label.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))
    said = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = rows.join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "own", "part", "good", "toxic"]
    one = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    alike = one.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least)
    # a text has a row for each part and label here, whatever the number of its copies
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    alike = alike.withColumn("first", first)
    spared = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(
        F.struct(F.col("own").alias("mask"), spared.alias("n")),
        F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - spared).alias("n")),
    )
    out = alike.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "s.mask", "s.n", "good", "toxic").where("n > 0")
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def lattice_edges(sets: DataFrame, n: int) -> DataFrame:
    """The sums on each edge: part, applied (a mask), filter (a number), ``COUNTS`` and shapley; all edges of each part.

    shapley: the filter's removed, summed over all n! orders: |S|! (n - 1 - |S|)! of them pass the edge (S, filter).
    """
    edges = [(s, f) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    at = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for s, f in edges])
    rows = sets.select("*", F.explode(at).alias("edge")).select("part", "mask", "n", "good", "toxic", "edge.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    before = F.col("mask").bitwiseAND(F.col("applied")) != 0

    def total(of: str, when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).alias(name)

    sums = rows.groupBy("part", "applied", "filter").agg(
        total("n", ~fails & ~before, "kept"),
        total("n", fails & ~before, "removed"),
        total("n", fails & before, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", fails & ~before, "good_lost"),
        total("toxic", fails & ~before, "toxic_lost"),
    )
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)]), F.bit_count("applied") + 1)
    return sums.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "filter")))


def order_steps(spark: SparkSession, filters: str) -> DataFrame:
    """Every order of the filters as a path: filter_order, step, applied, filter. n! * n rows, fixed by the filters."""
    rows = []
    for order in permutations(range(len(filters))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[k] for k in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit_filters(sets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, ``COUNTS``, shapley: one row for each part, order and step, zeros included.

    ``sets``: part, mask, n, good, toxic, as of ``failed_sets``, for any up to six filters. An empty table gives no row.
    """
    if not 1 <= len(filters) <= 6:
        raise ValueError("one to six filters")
    steps = order_steps(sets.sparkSession, filters)
    # the steps are as many as the filters make them (600 for five): broadcast at any size of the data
    return lattice_edges(sets, len(filters)).join(F.broadcast(steps), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by source."""
    docs, labels = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "labels"))
    return audit_filters(failed_sets(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic")))


OP13_SQL = r"""
WITH said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), rows AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents d LEFT JOIN said l ON d.doc_id = l.doc_id
), judged AS (
  SELECT part, good, toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails
  FROM rows
), sets AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x, left(filter_order, step - 1) AS applied
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), audit AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN translate(fails, applied || x, '') = fails THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN contains(fails, x) AND translate(fails, applied, '') = fails THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(fails, x) AND translate(fails, applied, '') <> fails THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN contains(fails, x) AND translate(fails, applied, '') = fails THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN contains(fails, x) AND translate(fails, applied, '') = fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM audit
"""

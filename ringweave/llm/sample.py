"""Training rows: a bounded sample of labelled documents, outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
#: Bytes of text that are learned from at most, shared out evenly among the labels.
SAMPLE_BYTES = 256 << 20
#: Rows of a sample that are sent to all; a larger one (many labels) is joined by key.
SENT_ROWS = 200_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is 0 modulo 5; a null doc_id (an empty text) is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(text, label) of at most ``per_class`` documents of each label, and how many there are of each.

    ``labels`` has doc_id and label (string). Only rows outside the held-out fold count, and all labels do; a doc_id
    with two different labels has none. The sample follows a hash of the doc_id, so it is the same in each run. Whole
    texts are taken, and of repeated doc_ids the least text. A label whose texts go beyond its share of
    ``most_bytes`` has fewer of them, the first in that order, one at least.
    """
    own = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label")
    )
    found = own.groupBy("label").agg(F.count("*").alias("n"))
    counts = {r["label"]: r["n"] for r in found.collect()}  # a row for each label
    if not counts:
        return [], {}
    # a part of each label by hash, a little over what is wanted, cut to it on the driver
    turn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30))
    share = F.least(F.lit(1.0), F.lit(per_class + 4 * per_class**0.5) / F.col("n"))
    some = own.join(found, "label").where(turn <= share * (1 << 30)).select("doc_id", "label")
    if len(counts) * per_class <= SENT_ROWS:
        some = F.broadcast(some)
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = (
        texts.join(some, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("label", "text", turn.alias("turn"))
    )
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy("label").orderBy("turn", "text"))
    got = got.withColumn("upto", before).withColumn("nth", first).where((F.col("upto") <= most_bytes // len(counts)) | (F.col("nth") == 1))
    rows = sorted((r["label"], r["turn"], r["text"]) for r in got.select("label", "turn", "text").toLocalIterator())
    out, taken = [], {}
    for label, _, text in rows:
        taken[label] = taken.get(label, 0) + 1
        if taken[label] <= per_class:
            out.append((text, label))
    return out, counts

"""From raw documents to packed sequences: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm import quality_model
from ringweave.llm.decontaminate import drop_contaminated
from ringweave.llm.packing import pack_documents
from ringweave.llm.quality_rules import judge_documents
from ringweave.llm.simhash import similar_documents
from ringweave.session import drop_stored, stored

CAPACITY = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their failing lines removed (and n_chars counted anew).

    The verdict is that on the lines alone: short clean documents stay, and the classifier judges them next. Null and empty texts are rejected; nulls in other columns stay; an empty table stays empty.
    """
    judged = judge_documents(docs, min_words=1, most_repeated=100).where("kept")

    def value(name: str) -> Column:
        if name == "text":
            return F.col("clean_text").alias("text")
        if name == "n_chars":
            return F.length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("doc").getField(name).alias(name)

    return judged.select(*map(value, docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    It learns from the labelled rows of ``docs``, cleaned as those it judges: the table that they come from may be gone
    by now. Labels of rows that are gone don't count in the odds of a class either. With no labels of one of the classes
    nothing is told apart and nothing rejected.
    """
    labels = _table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id", "left_semi")
    model = quality_model.learn(docs, labels)
    scored = quality_model.score_documents(docs, model).where("predicted = 1")
    return scored.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Texts are near duplicates at a Jaccard similarity of 0.8 or more of their five-word shingles; SimHashes find
    candidate groups, in which links are verified exactly.

    Of repeated rows of that doc_id the first by the other columns stays. Rows with a null doc_id all stay, as there
    is no id to choose them by. An empty table stays empty.
    """
    found = similar_documents(docs.select("doc_id", "text")).where("doc_id = component_id")
    kept = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    repeated = stored(kept.where("n > 1").select("doc_id"), "repeated-ids")
    rest = [c for c in docs.columns if c != "doc_id"]
    # only the rows of repeated doc_ids are brought together, a partial minimum for each
    one = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    one = one.select(*["doc_id" if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns])
    # the ids are as many as the documents kept: never broadcast, so that small inputs tell what large ones cost
    single = docs.join(kept.where("n = 1").hint("merge"), "doc_id", "left_semi")
    return single.unionByName(one).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most ``CAPACITY`` tokens, and their ids."""
    return pack_documents(docs, CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: Tokens and learned scores are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage has read is deleted once it is through."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        drop_stored(before)
    return docs

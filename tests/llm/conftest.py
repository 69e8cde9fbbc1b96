import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest  # noqa: E402

#: Nulls in any column, empty texts, ties, repeated rows, and columns whose names clash with the operators' own.
ROWS = [
    (None, None, None, None, "x", "k"),
    (1, "", "en", "s", "x", None),
    (1, "", "en", "s", "x", None),
    (2, "word", None, "s", "x", "k"),
    (3, "the same words in two rows make one text here.", "en", None, "x", "k"),
    (4, "the same words in two rows make one text here.", "en", "s", "x", "k"),
    (5, " \n\t ", "en", "s", "x", "k"),
    (6, "long " * 30_000, "en", "s", "x", "k"),
    (None, "the same words in two rows make one text here.", "en", "s", "x", "k"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string, f string"


@pytest.fixture(scope="session")
def odd(spark):
    """A table of odd rows with extra columns."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "doc", "shard", "kept", "length", "_rank", "cell", "row", "n_words", "k", "d", "component_id", "hot", "label"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

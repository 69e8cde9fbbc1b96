"""Quality rules, line first: each line passes or fails, failing lines go, and documents that lose too much go.

Only built-in functions are used. A text is split into lines and each line into words once; all counts and
rules read those arrays, so nothing is exploded or shuffled and a row's cost is in proportion to its text.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the controls from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: What a sentence ends with, and what may follow that. A line without any such end fails.
#: Latin, Greek and Cyrillic; then CJK, Arabic, Urdu, Devanagari, Ethiopic, Armenian, Burmese, Khmer; Tibetan.
TERMINAL = (".", "!", "?", ":", ";", "…", "。", "．", "｡", "！", "？", "：", "；", "؟", "؛", "۔", "।", "॥", "።", "፧", "։", "။", "។", "།", "༎", "༏", "༑", "༔")
#: Letters of scripts that end sentences with a space or with no mark at all: Thai, Lao, Khmer. A line that holds one
#: doesn't fail for want of an end.
UNMARKED = "[\u0e01-\u0e33\u0e40-\u0e46\u0e81-\u0eb3\u0ec0-\u0edf\u1780-\u17b3]"
CLOSING = "\"'”’»)]›」』）】》〉"
#: Ends of words in shouted or scrambled lines.
NOISE = ("!!", "??", "##", "**", "$$", "%%", "&&", "||", "<<", ">>")
#: Words that only part the entries of a menu.
SEPARATORS = ("|", "||", "»", "›", "•", "·", ">", "/")
#: Phrases of lines that belong to a site and not to its text; lower case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of service",
    "terms of use",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "click here to",
    "subscribe to our",
    "sign up for our",
    "skip to content",
    "back to top",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "allgemeine geschäftsbedingungen",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "todos los derechos reservados",
    "política de privacidad",
    "términos y condiciones",
    "все права защищены",
    "политика конфиденциальности",
    "版权所有",
    "隐私政策",
    "すべての権利を保有",
    "プライバシーポリシー",
    "جميع الحقوق محفوظة",
    "सर्वाधिकार सुरक्षित",
)
#: Held by each row and looked at by ``kept``: a filter on what isn't deterministic stays above the projection that
#: makes it, where Spark would else judge each text twice, to filter it and to return it.
_ROW = F.monotonically_increasing_id
#: A line fails with more than a third of its words noisy, 15 in 100 separators, or 8 and more words of which a
#: quarter or less differ.
NOISY_SHARE, SEPARATOR_SHARE, REPEAT_WORDS, DISTINCT_SHARE = 33, 15, 8, 25
#: A document that loses over so many in a hundred of its characters is rejected.
MOST_LOST = 30
#: A document with fewer words than that, or with over so many in a hundred of them in repeated windows, fails.
MIN_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _line(line: Column, words: Column) -> Column:
    """A line with its words, its characters in words, and the rule that it fails (null: none)."""
    n = F.size(words)
    count = lambda test: F.size(F.filter(words, test))
    ending = F.right(F.rtrim(line, F.lit(SPACE + CLOSING)), F.lit(1))
    lower = F.lower(line)
    phrase = lower.contains(BOILERPLATE[0])
    for p in BOILERPLATE[1:]:
        phrase = phrase | lower.contains(p)
    fails = (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(count(lambda w: w.isin(*SEPARATORS)) * 100 >= n * SEPARATOR_SHARE, "navigation")
        .when(~ending.isin(*TERMINAL) & ~F.exists(words, lambda w: F.right(w, F.lit(1)).isin(*TERMINAL)) & ~line.rlike(UNMARKED), "punctuation")
        .when(count(lambda w: F.right(w, F.lit(2)).isin(*NOISE)) * 100 > n * NOISY_SHARE, "punctuation")
        .when(phrase, "boilerplate")
        .when((n >= REPEAT_WORDS) & (F.size(F.array_distinct(words)) * 100 <= n * DISTINCT_SHARE), "boilerplate")
    )
    return F.struct(
        line.alias("line"), words.alias("words"), F.length(F.array_join(words, "")).cast("long").alias("chars"), fails.alias("fails")
    )


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that is found twice or more, each word once.

    Windows are compared by their 64-bit hashes. Only texts with equal windows are looked into: their windows
    are sorted with their places, and the places of equal ones cover three words each, counted where they
    don't overlap.
    """
    n = F.size(words)
    part = lambda k: F.slice(words, F.lit(k + 1), F.greatest(n - 2, F.lit(0)))
    hashes = F.transform(F.arrays_zip(part(0).alias("a"), part(1).alias("b"), part(2).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    def places(h: Column) -> Column:
        def repeated(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.array_sort(F.transform(let(placed, repeated), lambda x: x["i"]))

    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(places(h))))


def judge_documents(docs: DataFrame, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) in ``doc``, with counts, verdicts and the cleaned text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (long); failed_lines
    (array<struct<line, rule>>); base_failed (fewer than ``min_words`` words or none, or over ``most_repeated`` in a
    hundred of them in repeated windows; 1 and 100 leave the verdict to the lines alone); kept (not base_failed, and at most ``MOST_LOST`` in a hundred of its characters in failing lines);
    clean_text (the text without the failing lines; null where the text is null).

    Lines without words neither pass nor fail and stay. A null or empty text has no words and is not kept.
    Null doc_ids and repeated rows are judged each by itself; an empty table gives no rows. The columns of
    ``docs`` stay apart in the struct ``doc``, so no name clashes.
    """
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    lines = base.select("doc", F.transform(F.split(F.coalesce("doc.text", F.lit("")), "\n"), lambda x: let(_words(x), lambda w: _line(x, w))).alias("lines"), _ROW().alias("row"))
    total = lambda of: F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + of(x))
    text = F.coalesce("doc.text", F.lit(""))
    worded = F.transform(F.filter("lines", lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
    counted = lines.select(
        "doc",
        "lines",
        "row",
        total(lambda x: F.size(x["words"]).cast("long")).alias("n_words"),
        total(lambda x: x["chars"]).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(worded, lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
        let(F.flatten(F.transform("lines", lambda x: x["words"])), _repeat_words).alias("n_repeat_words"),
        total(lambda x: F.when(x["fails"].isNotNull(), x["chars"]).otherwise(F.lit(0).cast("long"))).alias("lost_chars"),
    )
    failed = (F.col("n_words") < max(1, min_words)) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * MOST_LOST
    stay = F.transform(F.filter("lines", lambda x: x["fails"].isNull()), lambda x: x["line"])
    gone = F.transform(F.filter("lines", lambda x: x["fails"].isNotNull()), lambda x: F.struct(x["line"].alias("line"), x["fails"].alias("rule")))
    return counted.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "lost_chars",
        gone.alias("failed_lines"),
        failed.alias("base_failed"),
        (~failed & ~lost & (F.col("row") >= 0)).alias("kept"),
        F.when(F.col("doc.text").isNotNull(), F.array_join(stay, "\n")).alias("clean_text"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for all documents."""
    judged = judge_documents(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).select("doc_id", "text"))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_WS = "[ \\t-\\r]+"
OP4_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT rid, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT rid, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)
), split AS (
  SELECT rid, i, line, list_filter(regexp_split_to_array(line, '{_WS}'), lambda w: w <> '') AS words FROM lines
), ruled AS (
  SELECT *, len(words) AS n, length(array_to_string(words, '')) AS chars,
    CASE WHEN len(words) = 0 THEN FALSE
      WHEN len(list_filter(words, lambda w: w IN ({_sql_list(SEPARATORS)}))) * 100 >= len(words) * {SEPARATOR_SHARE} THEN TRUE
      WHEN len(list_filter(words, lambda w: right(w, 1) IN ({_sql_list(TERMINAL)}))) = 0 AND NOT (right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || {_sql_list([CLOSING])}), 1) IN ({_sql_list(TERMINAL)})) AND NOT regexp_matches(line, '{UNMARKED}') THEN TRUE
      WHEN len(list_filter(words, lambda w: right(w, 2) IN ({_sql_list(NOISE)}))) * 100 > len(words) * {NOISY_SHARE} THEN TRUE
      WHEN {' OR '.join(f"contains(lower(line), {_sql_list([p])})" for p in BOILERPLATE)} THEN TRUE
      WHEN len(words) >= {REPEAT_WORDS} AND len(list_distinct(words)) * 100 <= len(words) * {DISTINCT_SHARE} THEN TRUE
      ELSE FALSE END AS fails
  FROM split
), per AS (
  SELECT rid, sum(n) AS n_words, sum(chars) AS word_chars, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost_chars,
    count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines
  FROM ruled GROUP BY rid
), words AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY i, j) AS p, w
  FROM (SELECT rid, i, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS w FROM split)
), grams AS (
  SELECT rid, p, w, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM words WINDOW d AS (PARTITION BY rid ORDER BY p)
), found AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, w, w2, w3) AS times FROM grams WHERE w3 IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT p + k) AS n_repeat_words
  FROM (SELECT rid, p, unnest([0, 1, 2]) AS k FROM found WHERE times > 1) GROUP BY rid
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (n_words < {MIN_WORDS} OR coalesce(n_repeat_words, 0) * 100 > n_words * {MOST_REPEATED}) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR coalesce(n_repeat_words, 0) * 100 > n_words * {MOST_REPEATED}) AND NOT (lost_chars * 100 > word_chars * {MOST_LOST}) AS kept,
  lost_chars::BIGINT AS lost_chars
FROM docs JOIN per USING (rid) LEFT JOIN covered USING (rid)
"""

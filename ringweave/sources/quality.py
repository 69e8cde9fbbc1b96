"""Reports of test and quality tools as counts: JUnit, trial logs, coverage, lint, complexity, TRX, SARIF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

COUNTS = ("tests", "failures", "errors", "skipped")
#: XML that doesn't begin with an element counts as missing.
_XML = "^\\s*(<\\?xml[^>]*>)?\\s*<"


def _bare(xml: Column) -> Column:
    """XML without its declaration and namespaces."""
    return F.regexp_replace(F.regexp_replace(xml, "^\\s*<\\?xml[^>]*>", ""), "\\sxmlns(:\\w+)?=\"[^\"]*\"", "")


def _attr(xml: Column, path: str) -> Column:
    """A sum or number in an XML text, 0 where there is none; nothing is parsed that isn't XML."""
    ok = xml.isNotNull() & xml.rlike(_XML)
    return F.when(ok, F.coalesce(F.xpath_number(_bare(xml), F.lit(path)), F.lit(0.0)))


def _long(x: Column) -> Column:
    return F.coalesce(F.when(F.isnan(x), 0.0).otherwise(x), F.lit(0.0)).cast("long")


def junit_counts(xml: Column | str) -> Column:
    """Counts of all test suites, nested ones too; zeros for a missing or odd file."""
    x = E.col(xml)
    ok = x.isNotNull() & x.rlike(_XML)
    # one path for all sums, as each call parses the text
    sums = F.xpath_string(_bare(x), F.lit("concat(" + ", ' ', ".join(f"sum(//testsuite/@{c})" for c in COUNTS) + ")"))
    none = F.array(*[F.lit("0")] * len(COUNTS))
    # what a lambda is given is worked out once
    one = F.transform(F.array(F.coalesce(F.when(ok, F.split(sums, " ")), none)), lambda n: F.struct(*[_long(n[i].cast("double")).alias(c) for i, c in enumerate(COUNTS)]))
    return one[0]


def trial_counts(log: Column | str) -> Column:
    """Counts of a test log's last summary line; without a ``Ran`` line the tests are the sum of its counts."""
    t = F.coalesce(E.col(log), F.lit(""))
    ran = F.regexp_extract(t, "Ran\\s+(\\d+)\\s+tests?\\s+in\\s+", 1).try_cast("long")
    last = F.try_element_at(F.regexp_extract_all(t, F.lit("(?m)^(?:PASSED|FAILED)\\s*\\(([^)]*)\\)\\s*$"), F.lit(1)), F.lit(-1))

    def n(*names: str) -> Column:
        out = F.lit(None).cast("long")
        for name in reversed(names):
            got = F.regexp_extract(F.coalesce(last, F.lit("")), f"(?i)(?:^|[^A-Za-z_]){name}\\s*=\\s*(\\d+)", 1).try_cast("long")
            out = F.coalesce(got, out)
        return F.coalesce(out, F.lit(0))

    skipped, failures, errors = n("skips", "skipped"), n("failures", "failure"), n("errors", "error")
    total = n("successes") + skipped + failures + errors + n("expectedfailures") + n("unexpectedsuccesses")
    tests = F.when(F.coalesce(ran, F.lit(0)) > 0, ran).otherwise(total)
    return F.struct(tests.cast("long").alias("tests"), failures.alias("failures"), errors.alias("errors"), skipped.alias("skipped"))


def test_counts(xml: Column | str, log: Column | str) -> Column:
    """The XML report's counts if there is one, else the log's, else zeros."""
    return F.when(E.col(xml).isNotNull(), junit_counts(xml)).otherwise(trial_counts(log))


def coverage_percent(xml: Column | str) -> Column:
    x = E.col(xml)
    rate = F.xpath_number(F.regexp_replace(x, "^\\s*<\\?xml[^>]*>(\\s*<!DOCTYPE[^>]*>)?", ""), F.lit("/*/@line-rate"))
    return F.when(x.rlike(_XML), F.bround(F.when(~F.isnan(rate), rate) * 100, 2))


def lint_issues(report: Column | str) -> Column:
    """Length of a JSON list, else the lines that aren't blank."""
    t = F.coalesce(E.col(report), F.lit(""))
    return F.coalesce(F.when(F.trim(t).startswith("["), F.json_array_length(t)), E.nonblank_lines(t)).cast("long")


def complexity_counts(report: DataFrame, key: str, text: str) -> DataFrame:
    """key, total and by_rank (map) of complexity reports, an object of lists or one list; no rank is ``?``."""
    t = F.col(text)
    root = F.when(F.trim(t).startswith("["), F.array(t)).otherwise(F.map_values(F.from_json(t, "map<string,string>")))
    entries = F.explode_outer(root).alias("f")
    lists = F.coalesce(*[F.get_json_object("f", f"$.{n}") for n in ("functions", "results", "blocks")], F.col("f"))
    per = report.select(key, entries).select(key, F.explode_outer(F.from_json(F.when(F.trim(lists).startswith("["), lists), "array<string>")).alias("e"))
    rank = F.coalesce(F.get_json_object("e", "$.rank"), F.get_json_object("e", "$.complexity.rank"), F.lit("?"))
    n = per.groupBy(key, F.when(F.col("e").isNotNull(), rank).alias("rank")).agg(F.count("e").alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "n"))))
    return n.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(pairs).alias("by_rank"))


def maintainability(report: Column | str) -> Column:
    """Mean, worst and number of the indexes of a report, an object or a list."""
    t = E.col(report)
    root = F.when(F.trim(t).startswith("["), F.from_json(t, "array<string>")).otherwise(F.map_values(F.from_json(t, "map<string,string>")))
    mis = F.filter(F.transform(F.coalesce(root, F.array().cast("array<string>")), lambda x: F.get_json_object(x, "$.mi").try_cast("double")), lambda x: x.isNotNull())
    total = F.aggregate(mis, F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.when(F.size(mis) > 0, F.bround(total / F.size(mis), 2)).alias("avg"), F.bround(F.array_min(mis), 2).alias("worst"), F.size(mis).cast("long").alias("files"))


def dead_code(text: Column | str) -> Column:
    """Suspects of a dead-code report, and how many have each confidence (60, 90 and 100 always there)."""
    lines = F.filter(F.transform(E.lines_of(F.coalesce(E.col(text), F.lit(""))), lambda x: F.trim(x)), lambda x: x.rlike("^.+:\\d+:\\s+"))
    conf = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, "\\((\\d+)% confidence\\)\\s*$", 1)), lambda x: x != "")
    keys = F.array_distinct(F.concat(F.array(F.lit("60"), F.lit("90"), F.lit("100")), conf))
    counts = F.transform(keys, lambda k: F.size(F.filter(conf, lambda c: c == k)).cast("long"))
    return F.struct(F.size(lines).cast("long").alias("suspects"), F.map_from_arrays(keys, counts).alias("by_confidence"))


def trx_counts(xml: Column | str) -> Column:
    """Counts of a TRX report; errors take in timeouts and aborts, tests that did not run are skipped."""
    x = E.col(xml)
    n = lambda a: _long(_attr(x, f"sum((//Counters)[1]/@{a})"))
    skipped = n("notExecuted") + n("notRunnable")
    rest = F.greatest(n("total") - n("executed"), F.lit(0))
    return F.struct(
        n("total").alias("tests"), n("failed").alias("failures"), (n("error") + n("timeout") + n("aborted")).alias("errors"), F.when(skipped == 0, rest).otherwise(skipped).alias("skipped")
    )


def trx_total(reports: DataFrame, key: str, xml: str) -> DataFrame:
    """Counts summed over the distinct TRX files (path) of each key."""
    own = reports.dropDuplicates([key, "path"]).select(key, trx_counts(xml).alias("t"))
    return own.groupBy(key).agg(*[F.sum(f"t.{c}").alias(c) for c in COUNTS])


SARIF = "struct<runs:array<struct<results:array<struct<level:string,suppressionStates:array<string>>>>>>"


def sarif_issues(reports: DataFrame, key: str, text: str) -> DataFrame:
    """Warnings and errors that are not suppressed; results without a level don't count."""
    results = F.flatten(F.transform(F.coalesce(F.from_json(text, SARIF)["runs"], F.array().cast("array<struct<results:array<struct<level:string,suppressionStates:array<string>>>>>")), lambda r: F.coalesce(r["results"], F.array().cast("array<struct<level:string,suppressionStates:array<string>>>"))))
    hit = F.filter(results, lambda r: (F.coalesce(F.size(r["suppressionStates"]), F.lit(0)) <= 0) & F.lower(F.trim(r["level"])).isin("warning", "error"))
    return reports.groupBy(key).agg(F.sum(F.size(hit)).cast("long").alias("issues"))


def lizard_metrics(rows: DataFrame, key: str, over: tuple[int, int] = (20, 40)) -> DataFrame:
    """Of headerless complexity rows (key, _c0, _c5, _c6): total, nearest-rank 95th percentile, counts over limits,
    functions and files. Rows whose first cell is no number are skipped."""
    strip = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("")))
    ccn = F.trim("_c0").try_cast("int")
    path = F.when(strip(F.col("_c6")) != "", strip(F.col("_c6"))).otherwise(F.trim(F.element_at(F.split(strip(F.col("_c5")), "@"), -1)))
    own = rows.select(key, ccn.alias("n"), F.when(path != "", path).alias("f")).where("n is not null")
    return own.groupBy(key).agg(
        F.sum("n").cast("long").alias("cc_total"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("cc_p95"),
        E.count_if(F.col("n") > over[0]).alias("cc_over_20"),
        E.count_if(F.col("n") > over[1]).alias("cc_over_40"),
        F.count("*").alias("functions"),
        F.countDistinct("f").alias("files"),
    )


def nonblank_loc(lines: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """Lines of each file that aren't blank."""
    return lines.groupBy(*keys).agg(E.count_if(F.regexp_replace(line, "\\s+", "") != "").alias("loc"))

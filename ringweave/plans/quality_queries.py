"""Reports of test and quality tools, and the documents made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import evaluate
from ..session import spread
from ..sources import quality, runs, sinks
from .facts import register, table

Q: dict = {}
SQL: dict[str, str] = {}


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _key():
    return F.col("c_custkey")


def _nation():
    return F.col("c_nationkey")


def _customers(spark, sf_dir):
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")


@register(Q, SQL, """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 4 THEN round_even((c_custkey % 10000 / 10000.0::DOUBLE) * 100, 2) END AS pct FROM customer""")
def coverage_percent(spark, sf_dir):
    rate = F.format_number((_key() % 10000) / 10000, 4)
    xml = F.when(_key() % 5 == 4, "no xml").otherwise(_text('<?xml version="1.0" ?>\n<!DOCTYPE coverage SYSTEM "x.dtd">\n<coverage line-rate="', rate, '"><packages line-rate="9"/></coverage>'))
    return _customers(spark, sf_dir).select("c_custkey", quality.coverage_percent(xml).alias("pct"))


@register(Q, SQL, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_nationkey % 4 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS issues FROM customer")
def lint_issues(spark, sf_dir):
    listed = F.concat(F.lit(" ["), F.array_join(F.array_repeat(F.lit('{"code": "E1"}'), (_nation() % 4).cast("int")), ","), F.lit("]"))
    report = F.when(_key() % 3 == 0, listed).when(_key() % 3 == 1, "a.py:1 E1\n\n  \na.py:2 E2\n")
    return _customers(spark, sf_dir).select("c_custkey", quality.lint_issues(report).alias("issues"))


@register(Q, SQL, """WITH b AS (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['A', 'B', 'A'] ELSE ['C', '?', 'C'] END || (CASE WHEN c_nationkey % 2 = 0 THEN ['F'] ELSE [] END)) AS rank FROM customer),
n AS (SELECT c_custkey, rank, count(*) AS n FROM b GROUP BY ALL) SELECT c_custkey, sum(n)::BIGINT AS total, string_agg(rank || '=' || n, ',' ORDER BY rank) AS ranks FROM n GROUP BY ALL""")  # fmt: skip
def complexity_counts(spark, sf_dir):
    more = F.when(_nation() % 2 == 0, ', {"rank": "F"}').otherwise("")
    text = F.when(_key() % 2 == 0, _text('{"a.py": [{"rank": "A"}, {"complexity": {"rank": "B"}}', more, '], "b.py": [{"rank": "A"}]}')).otherwise(_text('[{"rank": "C"}, {"name": "x"}, {"rank": "C"}', more, "]"))
    got = quality.complexity_counts(_customers(spark, sf_dir).withColumn("text", text), "c_custkey", "text")
    pairs = F.array_sort(F.map_entries("by_rank"))
    return got.select("c_custkey", "total", F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("ranks"))


@register(Q, SQL, """WITH m AS (SELECT c_custkey, list_filter([c_nationkey + 0.25::DOUBLE, c_custkey % 90 + 0.125::DOUBLE, CASE WHEN c_custkey % 3 > 0 THEN 50.0::DOUBLE END], lambda x: x IS NOT NULL) AS v FROM customer)
SELECT c_custkey, round_even(list_sum(v) / len(v), 2) AS avg, round_even(list_min(v), 2) AS worst, len(v)::BIGINT AS files FROM m""")  # fmt: skip
def maintainability(spark, sf_dir):
    third = F.when(_key() % 3 > 0, '{"mi": 50.0}').otherwise('{"error": "x"}')
    entry = lambda x, f: _text('{"mi": ', x, f, "}")
    a, b = entry(_nation(), ".25"), entry(_key() % 90, ".125")
    text = F.when(_key() % 2 == 0, _text("[", a, ",", b, ",", third, "]")).otherwise(_text('{"a.py": ', a, ', "b.py": ', b, ', "c.py": ', third, "}"))
    return _customers(spark, sf_dir).select("c_custkey", quality.maintainability(text).alias("m")).select("c_custkey", "m.*")


@register(Q, SQL, """SELECT c_custkey, (1 + c_nationkey % 3)::BIGINT AS suspects, (c_nationkey % 3)::BIGINT AS sixty, 0::BIGINT AS ninety, 0::BIGINT AS hundred, 1::BIGINT AS seventy FROM customer""")
def dead_code(spark, sf_dir):
    lines = F.concat(F.lit("a.py:3: unused x (70% confidence)\nnot a finding\n"), F.array_join(F.array_repeat(F.lit("b.py:9: unused y (60% confidence)"), (_nation() % 3).cast("int")), "\n"))
    d = _customers(spark, sf_dir).select("c_custkey", quality.dead_code(lines).alias("d"))
    return d.select("c_custkey", "d.suspects", *[F.col("d.by_confidence")[k].alias(n) for k, n in (("60", "sixty"), ("90", "ninety"), ("100", "hundred"), ("70", "seventy"))])


@register(Q, SQL, """WITH t AS (SELECT DISTINCT c_mktsegment, c_nationkey, c_custkey % 3 AS v FROM customer)
SELECT c_mktsegment, sum(100 + c_nationkey)::BIGINT AS tests, sum(c_nationkey)::BIGINT AS failures, sum(6)::BIGINT AS errors, sum(CASE WHEN v = 0 THEN 7 WHEN v = 1 THEN 5 ELSE 0 END)::BIGINT AS skipped FROM t GROUP BY ALL""")  # fmt: skip
def trx_totals(spark, sf_dir):
    v = _key() % 3
    left, done = F.when(v == 0, 7).otherwise(0), F.when(v == 1, _nation() + 95).otherwise(_nation() + 100)
    xml = _text('<?xml version="1.0"?><TestRun xmlns="http://x/y"><ResultSummary><Counters total="', _nation() + 100, '" executed="', done, '" failed="', _nation(), '" error="1" timeout="2" aborted="3" notExecuted="', left, '"/></ResultSummary></TestRun>')
    c = _customers(spark, sf_dir).withColumns({"path": F.concat_ws("/", "c_nationkey", v.cast("string")), "xml": xml})
    return quality.trx_total(c, "c_mktsegment", "xml")


@register(Q, SQL, """SELECT c_mktsegment, sum(1 + c_nationkey % 2)::BIGINT AS issues FROM customer GROUP BY ALL""")
def sarif_issues(spark, sf_dir):
    more = F.when(_nation() % 2 == 1, ', {"level": " Error "}').otherwise("")
    text = _text('{"runs": [{"results": [{"level": "warning"}, {"level": "note"}, {"ruleId": "x"}, {"level": "error", "suppressionStates": ["suppressedInSource"]}', more, ']}, {"tool": {}}]}')
    return quality.sarif_issues(_customers(spark, sf_dir).withColumn("text", text), "c_mktsegment", "text")


@register(Q, SQL, """SELECT c_custkey, (CASE c_custkey % 3 WHEN 0 THEN 9 WHEN 1 THEN c_nationkey + 4 ELSE 0 END)::BIGINT AS tests, (CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END)::BIGINT AS failures FROM customer""")
def test_source(spark, sf_dir):
    xml = F.when(_key() % 3 == 0, '<testsuite tests="9" failures="2"/>')
    log = F.when(_key() % 3 < 2, _text("Ran ", _nation() + 4, " tests in 1s\nFAILED (failures=4)\n"))
    return _customers(spark, sf_dir).select("c_custkey", quality.test_counts(xml, log).alias("t")).select("c_custkey", "t.tests", "t.failures")


@register(Q, SQL, """SELECT p_brand, p_type, count(*) FILTER (trim(regexp_replace(p_name, '\\s+', '', 'g')) <> '' AND p_partkey % 4 > 0)::BIGINT AS loc FROM part GROUP BY ALL""")
def nonblank_loc(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", F.when(F.col("p_partkey") % 4 == 0, " \t ").otherwise(F.col("p_name")).alias("value"))
    return quality.nonblank_loc(p, ["p_brand", "p_type"])


_METRICS = """SELECT c_custkey, 'python' AS language, c_nationkey::BIGINT AS tests, 1::BIGINT AS failures, 0::BIGINT AS errors, 2::BIGINT AS skipped, greatest(0, c_nationkey - 3)::BIGINT AS passed FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'csharp', c_nationkey, 1, 0, 2, greatest(0, c_nationkey - 3) FROM customer WHERE c_custkey % 2 = 1"""


@register(Q, SQL, _METRICS)
def metrics_documents(spark, sf_dir):
    """Metrics documents are made, and the counts of their tests read from them."""
    language = F.when(_key() % 2 == 0, "python").otherwise("csharp")
    block = F.struct(_nation().cast("long").alias("tests"), F.lit(1).alias("failures"), F.lit(0).alias("errors"), F.lit(2).alias("skipped"))
    docs = _customers(spark, sf_dir).select("c_custkey", sinks.metrics_document(language, block, coverage=F.lit(1.5)).alias("doc"))
    tests = "struct<tests:bigint,failures:bigint,errors:bigint,skipped:bigint>"
    own = docs.select("c_custkey", F.from_json("doc", f"struct<language:string,pytest:{tests},dotnet_test:{tests}>").alias("d")).select("c_custkey", "d.*")
    return evaluate.test_counts(own, "c_custkey").join(own.select("c_custkey", "language"), "c_custkey")


@register(Q, SQL, """SELECT user_id, string_agg(rid, ',' ORDER BY event_id) AS responses, count(*) FILTER (event_type = 'signup')::BIGINT AS finished, max(event_id)::BIGINT AS prompt_tokens, (arg_max(user_id, event_id) % 7)::BIGINT AS completion_tokens,
CASE WHEN user_id % 2 = 0 THEN 'done' ELSE '' END AS outcome
FROM (SELECT *, 'r' || (event_id % 5) AS rid FROM events) GROUP BY user_id""")  # fmt: skip
def trajectories(spark, sf_dir):
    """Trajectories made of a user's events in order, read as events, last usage and outcome."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    entry = F.to_json(
        F.struct(
            F.when(F.col("event_type") == "signup", "finish").otherwise("run").alias("action"),
            F.struct(F.struct(F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("id")).alias("model_response")).alias("tool_call_metadata"),
            F.struct(F.struct(F.col("event_id").alias("prompt_tokens"), (F.col("user_id") % 7).alias("completion_tokens")).alias("accumulated_token_usage")).alias("llm_metrics"),
        )
    )
    own = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("x")))).alias("a"))
    # members that are no objects are dropped
    text = F.concat(F.lit('["odd", '), F.array_join(F.transform("a", lambda x: x["x"]), ", "), F.lit("]"))
    status = F.when(F.col("user_id") % 2 == 0, '{"outcome": " done "}').otherwise("{broken")
    r = own.select("user_id", text.alias("trajectory"), status.alias("status"))
    # the last member of a user's list is its latest event
    usage = r.select("user_id", runs.last_usage(F.concat(F.lit("["), F.regexp_replace("trajectory", '^\\["odd", ', ""))).alias("u"), runs.outcome_of("status").alias("outcome"))
    ids = runs.trajectory_events(r, ["user_id"]).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "response_id"))), lambda x: x["response_id"]), ",").alias("responses"), E.count_if(F.col("is_finish")).alias("finished")
    )
    return ids.join(usage, "user_id").select("user_id", "responses", "finished", "u.prompt_tokens", "u.completion_tokens", "outcome")

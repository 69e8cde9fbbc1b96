"""Result tables over the stand-in facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import stats, tables
from .facts import BASELINE, FACTS_SQL, SELECTED, facts, raw_runs, register, sql_pct, table

Q: dict = {}
SQL: dict[str, str] = {}
_N = "count(*) FILTER ({0} = 1)"
_OUT = ", ".join(f"{sql_pct(_N.format(c), 'count(*)')} AS {n}" for c, n in (("behavior_preserved", "behavior_pct"), ("cycle_broken", "broken_pct"), ("local_improvement", "local_pct"), ("success", "success_pct")))
_BIN = "CASE WHEN cycle_size BETWEEN 2 AND 3 THEN '2--3' WHEN cycle_size BETWEEN 4 AND 6 THEN '4--6' WHEN cycle_size BETWEEN 7 AND 8 THEN '7--8' END"


def _cells(dims: dict[str, str]) -> str:
    """Outcome shares for the cross product of modes and the dimensions' values."""
    names = list(dims)
    axes = " CROSS JOIN ".join(f"({q}) AS x{i}({n})" for i, (n, q) in enumerate(dims.items()))
    got = f"SELECT mode_id, {', '.join(names)}, count(*) AS runs, {_OUT} FROM own GROUP BY ALL"
    return f"""{FACTS_SQL}, own AS (SELECT *, {_BIN} AS cycle_size_bin FROM facts), got AS ({got})
    SELECT m.mode_id, {', '.join(f'{n}' for n in names)}, coalesce(runs, 0)::BIGINT AS runs, behavior_pct, broken_pct, local_pct, success_pct
    FROM (SELECT DISTINCT mode_id FROM own) m CROSS JOIN {axes} LEFT JOIN got USING (mode_id, {', '.join(names)})"""


_SIZES = "SELECT unnest(['2--3', '4--6', '7--8'])"


@register(Q, SQL, f"{FACTS_SQL} SELECT mode_id, mode_label AS configuration, count(*)::BIGINT AS runs, {_OUT} FROM facts GROUP BY ALL")
def main_results(spark, sf_dir):
    return tables.main_results(facts(spark, sf_dir))


@register(Q, SQL, _cells({"language": "SELECT DISTINCT language FROM facts"}))
def language_breakdown(spark, sf_dir):
    return tables.language_breakdown(facts(spark, sf_dir))


@register(Q, SQL, _cells({"cycle_size_bin": _SIZES}))
def size_breakdown(spark, sf_dir):
    return tables.size_breakdown(facts(spark, sf_dir))


@register(Q, SQL, _cells({"cycle_size_bin": _SIZES, "language": "SELECT DISTINCT language FROM facts"}))
def size_language_breakdown(spark, sf_dir):
    return tables.size_language_breakdown(facts(spark, sf_dir))


@register(Q, SQL, f"""{FACTS_SQL}, got AS (SELECT repo, mode_id, count(*) AS runs, count(*) FILTER (success = 1) AS successes FROM facts GROUP BY ALL)
SELECT repo, mode_id, coalesce(runs, 0)::BIGINT AS runs, coalesce(successes, 0)::BIGINT AS successes, {sql_pct('successes', 'runs')} AS success_pct
FROM (SELECT DISTINCT repo FROM facts) r CROSS JOIN (SELECT DISTINCT mode_id FROM facts) m LEFT JOIN got USING (repo, mode_id)""")  # fmt: skip
def repo_success(spark, sf_dir):
    return tables.repo_success(facts(spark, sf_dir))


@register(Q, SQL, f"""{FACTS_SQL} SELECT mode_id, count(*)::BIGINT AS runs, count(*) FILTER (structurally_evaluable = 1)::BIGINT AS evaluable,
count(*) FILTER (other_incomplete = 1)::BIGINT AS incomplete FROM facts GROUP BY ALL""")  # fmt: skip
def run_accounting(spark, sf_dir):
    return tables.run_accounting(facts(spark, sf_dir))


_S, _W = "structural_improvement_raw = 1", "weakening_improvement_raw = 1"


@register(Q, SQL, f"""{FACTS_SQL} SELECT mode_id, count(*)::BIGINT AS denominator, {sql_pct(f'count(*) FILTER ({_S})', 'count(*)')} AS structural_pct,
{sql_pct(f'count(*) FILTER ({_W})', 'count(*)')} AS weakening_pct, {sql_pct(f'count(*) FILTER (NOT ({_S}) AND NOT ({_W}))', 'count(*)')} AS none_pct
FROM facts WHERE structurally_evaluable = 1 AND behavior_preserved = 1 AND cycle_broken = 1 GROUP BY ALL""")  # fmt: skip
def structural_decomposition(spark, sf_dir):
    return tables.structural_decomposition(facts(spark, sf_dir))


_MORE, _OUTSIDE = "post_global_redundancy > baseline_global_redundancy", "global_regression_outside_target_raw = 1"


@register(Q, SQL, f"""{FACTS_SQL} SELECT mode_id, count(*)::BIGINT AS denominator,
{sql_pct('count(*) FILTER (global_structural_regression_raw = 1)', 'count(*)')} AS any_pct, {sql_pct(f'count(*) FILTER ({_MORE})', 'count(*)')} AS redundancy_pct,
{sql_pct(f'count(*) FILTER ({_OUTSIDE})', 'count(*)')} AS outside_pct, {sql_pct(f'count(*) FILTER ({_MORE} AND {_OUTSIDE})', 'count(*)')} AS both_pct
FROM facts WHERE structurally_evaluable = 1 AND behavior_preserved = 1 GROUP BY ALL""")  # fmt: skip
def regression_criteria(spark, sf_dir):
    return tables.regression_criteria(facts(spark, sf_dir))


@register(Q, SQL, f"""{FACTS_SQL}, n AS (SELECT mode_id, count(*) FILTER (local_improvement = 1) AS improved,
count(*) FILTER (local_improvement = 1 AND global_structural_regression_raw = 1) AS regressed,
count(*) FILTER (local_improvement = 1 AND global_structural_regression_raw = 1 AND {_OUTSIDE}) AS outside FROM facts GROUP BY ALL)
SELECT mode_id, improved::BIGINT AS improved, regressed::BIGINT AS regressed, outside::BIGINT AS outside, {sql_pct('regressed', 'improved')} AS regressed_pct,
{sql_pct('outside', 'improved')} AS outside_pct FROM n""")  # fmt: skip
def local_global(spark, sf_dir):
    return tables.local_global(facts(spark, sf_dir))


_Q = "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"


@register(Q, SQL, f"""{FACTS_SQL} SELECT mode_id, median(files_modified)::DOUBLE AS median_files, round(({_Q.format('files_modified::DOUBLE')}), 6) AS iqr_files,
median(chars_changed)::DOUBLE AS median_chars, round(({_Q.format('chars_changed::DOUBLE')}), 6) AS iqr_chars,
(median(chars_changed) FILTER (success = 1))::DOUBLE AS median_chars_success FROM facts GROUP BY ALL""")  # fmt: skip
def edit_footprint(spark, sf_dir):
    return tables.edit_footprint(facts(spark, sf_dir))


@register(Q, SQL, f"""{FACTS_SQL} SELECT mode_id, round_even(avg(explanation_chars), 0)::BIGINT AS mean_expl, round_even(median(explanation_chars), 0)::BIGINT AS median_expl
FROM facts WHERE explanation_chars IS NOT NULL GROUP BY ALL""")  # fmt: skip
def explanation_length(spark, sf_dir):
    return tables.explanation_length(facts(spark, sf_dir))


@register(Q, SQL, f"""{FACTS_SQL}, own AS (SELECT mode_id, success, CASE WHEN cost > 0 THEN cost END AS c, CASE WHEN cost > 0 AND success = 1 THEN cost END AS w FROM facts)
SELECT mode_id, round(avg(c), 6) AS mean_cost, round({_Q.format('c')}, 6) AS iqr_cost, round(avg(w), 6) AS mean_cost_success,
count(*) FILTER (success = 1)::BIGINT AS successes FROM own GROUP BY ALL""")  # fmt: skip
def cost_efficiency(spark, sf_dir):
    return tables.cost_efficiency(facts(spark, sf_dir))


@register(Q, SQL, f"""{FACTS_SQL} SELECT repo, cycle_id, mode_id, avg(success::DOUBLE) AS rate, sum(success)::BIGINT AS successes, count(*)::BIGINT AS trials FROM facts GROUP BY ALL""")
def cycle_rates(spark, sf_dir):
    return tables.cycle_rates(facts(spark, sf_dir))


_RATES = f"{FACTS_SQL}, rates AS (SELECT repo, cycle_id, mode_id, avg(success::DOUBLE) AS rate, sum(success) AS w, count(*) AS t FROM facts GROUP BY ALL)"


@register(Q, SQL, f"""{_RATES} SELECT repo, cycle_id, 100.0::DOUBLE * (l.rate - r.rate) AS delta FROM rates l JOIN rates r USING (repo, cycle_id)
WHERE l.mode_id = '{SELECTED}' AND r.mode_id = '{BASELINE}'""")  # fmt: skip
def paired_differences(spark, sf_dir):
    return tables.paired_differences(tables.cycle_rates(facts(spark, sf_dir)), SELECTED, BASELINE)


@register(Q, SQL, f"""{_RATES}, d AS (SELECT 100.0::DOUBLE * (l.rate - r.rate) AS delta FROM rates l JOIN rates r USING (repo, cycle_id)
WHERE l.mode_id = '{SELECTED}' AND r.mode_id = '{BASELINE}') SELECT count(*)::BIGINT AS paired, round(avg(delta), 6) AS delta FROM d""")  # fmt: skip
def paired_delta(spark, sf_dir):
    d = tables.paired_differences(tables.cycle_rates(facts(spark, sf_dir)), SELECTED, BASELINE)
    return d.agg(F.count("*").alias("paired"), F.round(F.avg("delta"), 6).alias("delta"))


@register(Q, SQL)
def bootstrap_ci(spark, sf_dir):
    """The comparisons that the modes at hand allow, under the names that modes have in plans."""
    named = {BASELINE: "no_explain", SELECTED: "explain_E1_S1_noaux", "N": "explain_E0_S0_noaux"}
    mode = F.coalesce(*[F.when(F.col("mode_id") == k, v) for k, v in named.items()], F.col("mode_id"))
    own = facts(spark, sf_dir).withColumn("mode_id", mode)
    modes = {r["mode_id"] for r in own.select("mode_id").distinct().collect()}  # three
    return stats.compare_modes(own, stats.comparisons_of(modes))


@register(Q, SQL)
def glmm_fit(spark, sf_dir):
    rows = stats.configuration_model(facts(spark, sf_dir), BASELINE, SELECTED)
    return spark.createDataFrame([tuple(None if x != x else x for x in r) for r in rows.itertuples(index=False)], "effect string, coefficient double, odds_ratio double, ci string, p string")


_FACTORS = {"Cycle centrality": ("cycle_centrality", (1.0, 2.0), tables.E.BIN_ORDER[0:3]), "Enclosing SCC size": ("baseline_scc_size", (10, 50), tables.E.BIN_ORDER[9:12]),
            "Repository size": ("repo_dependency_graph_size", (100, 300), tables.E.BIN_ORDER[6:9]), "Cycle external connectivity": ("cycle_external_edges", (50, 100), tables.E.BIN_ORDER[3:6])}
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS factor, CASE WHEN {c} <= {a} THEN '{x}' WHEN {c} <= {b} THEN '{y}' ELSE '{z}' END AS bin, repo, cycle_id, mode_id, success FROM facts" for n, (c, (a, b), (x, y, z)) in _FACTORS.items())
_B, _A = f"mode_id = '{BASELINE}'", f"mode_id = '{SELECTED}'"


@register(Q, SQL, f"""{FACTS_SQL}, long AS ({_LONG}), n AS (SELECT factor, bin, count(DISTINCT (repo, cycle_id)) AS cycles, count(*) FILTER ({_B}) AS br, count(*) FILTER ({_A}) AS sr,
count(*) FILTER ({_B} AND success = 1) AS bw, count(*) FILTER ({_A} AND success = 1) AS sw FROM long GROUP BY ALL)
SELECT factor, bin, cycles::BIGINT AS cycles, CASE WHEN br = sr THEN br::VARCHAR ELSE br || '/' || sr END AS runs_per_configuration, bw::BIGINT AS baseline_successes,
{sql_pct('bw', 'br')} AS baseline_pct, sw::BIGINT AS selected_successes, {sql_pct('sw', 'sr')} AS selected_pct FROM n""")  # fmt: skip
def structural_bins(spark, sf_dir):
    return tables.structural_bins(facts(spark, sf_dir), BASELINE, SELECTED)


@register(Q, SQL, f"""{_RATES}, pair AS (SELECT b.w AS bw, b.t AS bt, s.w AS sw, s.t AS st, 100.0::DOUBLE * (b.w + s.w) / (b.t + s.t) AS p FROM rates b JOIN rates s USING (repo, cycle_id)
WHERE b.mode_id = '{BASELINE}' AND s.mode_id = '{SELECTED}'), binned AS (SELECT *, CASE WHEN p = 0 THEN '0%' WHEN p <= 10 THEN '>0--10%' WHEN p <= 25 THEN '>10--25%'
WHEN p <= 50 THEN '>25--50%' WHEN p <= 75 THEN '>50--75%' WHEN p < 100 THEN '>75--<100%' ELSE '100%' END AS bin FROM pair)
SELECT l.bin, count(p)::BIGINT AS cycles, {sql_pct('sum(bw)', 'sum(bt)')} AS baseline_pct, {sql_pct('sum(sw)', 'sum(st)')} AS selected_pct
FROM (SELECT unnest({E.DIFFICULTY_BINS}) AS bin) l LEFT JOIN binned USING (bin) GROUP BY l.bin""")  # fmt: skip
def difficulty_bins(spark, sf_dir):
    return tables.difficulty_bins(tables.cycle_rates(facts(spark, sf_dir)), BASELINE, SELECTED)


_PROPS = ["cycle_centrality", "baseline_scc_size", "repo_dependency_graph_size", "cycle_external_edges"]
_CYCLES = f"cycles AS (SELECT DISTINCT repo, cycle_id, language AS split, cycle_size, {', '.join(_PROPS)} FROM facts)"


def _cycles(spark, sf_dir):
    return facts(spark, sf_dir).select("repo", "cycle_id", F.col("language").alias("split"), "cycle_size", *_PROPS).distinct()


@register(Q, SQL, f"{FACTS_SQL}, {_CYCLES}, long AS ({' UNION ALL '.join(f'''SELECT '{p}' AS property, split, {p}::DOUBLE AS v FROM cycles''' for p in _PROPS)})" + """
SELECT property, split, count(*)::BIGINT AS n, round(quantile_cont(v, 0.25), 2) AS q1, round(quantile_cont(v, 0.5), 2) AS med, round(quantile_cont(v, 0.75), 2) AS q3,
round(min(v), 2) AS lo, round(max(v), 2) AS hi FROM long GROUP BY ALL""")  # fmt: skip
def dataset_characterisation(spark, sf_dir):
    return tables.characterise(_cycles(spark, sf_dir), "split", _PROPS)


@register(Q, SQL, f"{FACTS_SQL}, {_CYCLES}, long AS ({' UNION ALL '.join(f"""SELECT '{p}' AS property, split, {p}::DOUBLE AS v FROM cycles""" for p in _PROPS)}), " + """
q AS (SELECT property, split, round(quantile_cont(v, 0.25), 2) AS q1, round(quantile_cont(v, 0.5), 2) AS med, round(quantile_cont(v, 0.75), 2) AS q3, round(min(v), 2) AS lo, round(max(v), 2) AS hi FROM long GROUP BY ALL)
SELECT property, split, format('{:,.2f}', med) AS median_text, format('{:,.2f}', q1) || '--' || format('{:,.2f}', q3) AS iqr_text, format('{:,.2f}', lo) || '--' || format('{:,.2f}', hi) AS range_text FROM q""")  # fmt: skip
def characterised_texts(spark, sf_dir):
    return tables.with_texts(tables.characterise(_cycles(spark, sf_dir), "split", _PROPS)).select("property", "split", "median_text", "iqr_text", "range_text")


@register(Q, SQL)
def single_factors(spark, sf_dir):
    rows = stats.single_factor_models(facts(spark, sf_dir).where(F.col("mode_id").isin(BASELINE, SELECTED)), SELECTED, {"Cycle size": ("cycle_size", False), "Cycle centrality": ("cycle_centrality", True)})
    return spark.createDataFrame([tuple(None if x != x else x for x in r) for r in rows.itertuples(index=False)], "factor string, coefficient double, odds_ratio double, ci string")


@register(Q, SQL, f"""{FACTS_SQL}, {_CYCLES}, n AS (SELECT split, cycle_size, count(*) AS n FROM cycles GROUP BY ALL)
SELECT split, cycle_size::INTEGER AS cycle_size, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['python', 'csharp']) AS split) CROSS JOIN (SELECT unnest(range(2, 9)) AS cycle_size)
LEFT JOIN n USING (split, cycle_size)""")  # fmt: skip
def size_grid(spark, sf_dir):
    return tables.size_grid(_cycles(spark, sf_dir), "split", "cycle_size", ["python", "csharp"], range(2, 9))


@register(Q, SQL, f"""{FACTS_SQL} SELECT language, {', '.join(f"{sql_pct(f'''count(*) FILTER (success = 1 AND mode_id = '{m}')''', f'''count(*) FILTER (mode_id = '{m}')''')} AS mode_{m}" for m in 'RAN')} FROM facts GROUP BY ALL""")
def success_pivot(spark, sf_dir):
    p = tables.success_pivot(tables.language_breakdown(facts(spark, sf_dir)), "language", ["R", "A", "N"])
    return p.select("language", *[F.col(m).alias(f"mode_{m}") for m in "RAN"])


@register(Q, SQL, """WITH r AS (SELECT c_mktsegment AS g, floor(c_acctbal)::BIGINT AS stars, c_custkey AS loc FROM customer)
SELECT coalesce(g, 'All') AS grp, count(*)::BIGINT AS repositories, round_even(median(stars), 0)::BIGINT AS stars_median, min(stars) AS stars_min, max(stars) AS stars_max,
round_even(median(loc), 0)::BIGINT AS loc_median, min(loc) AS loc_min, max(loc) AS loc_max FROM r GROUP BY ROLLUP (g)""")  # fmt: skip
def repo_summary_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.floor("c_acctbal").cast("long").alias("stars"), F.col("c_custkey").alias("loc"))
    return tables.repo_summary(r, "g", ["stars", "loc"])


@register(Q, SQL, """WITH own AS (SELECT user_id, event_type AS mode_id, (props::JSON ->> 'k') AS rid FROM events), per AS (
SELECT user_id, count(DISTINCT rid) AS responses, bool_or(mode_id = 'signup') AS finished FROM own GROUP BY user_id),
runs AS (SELECT DISTINCT user_id, mode_id FROM own),
n AS (SELECT mode_id, count(*) AS runs, count(responses) AS with_trajectory, count(*) FILTER (responses >= 25) AS reached,
count(*) FILTER (responses >= 25 AND NOT finished) AS reached_unfinished FROM runs LEFT JOIN per USING (user_id) GROUP BY ALL)
SELECT mode_id, runs::BIGINT AS runs, with_trajectory::BIGINT AS with_trajectory, reached::BIGINT AS reached, reached_unfinished::BIGINT AS reached_unfinished, """ + f"""
{sql_pct('reached', 'runs')} AS reached_pct, {sql_pct('reached_unfinished', 'runs')} AS unfinished_pct FROM n""")  # fmt: skip
def iteration_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("mode_id"), F.get_json_object("props", "$.k").alias("response_id"), (F.col("event_type") == "signup").alias("is_finish"))
    summary = tables.trajectory_summary(e, ["user_id"], 25)
    return tables.iteration_limit(e.select("user_id", "mode_id").distinct(), summary, ["user_id"])


@register(Q, SQL, f"""{FACTS_SQL}, s AS (SELECT avg(ln(1 + chars_changed::DOUBLE)) AS m, stddev_samp(ln(1 + chars_changed::DOUBLE)) AS s FROM raw)
SELECT mode_id, count(*)::BIGINT AS n, round(avg((ln(1 + chars_changed::DOUBLE) - m) / s), 6) AS mean_z FROM raw, s GROUP BY ALL""")  # fmt: skip
def zscore_log1p(spark, sf_dir):
    return stats.zscore_log1p(raw_runs(spark, sf_dir), "chars_changed").groupBy("mode_id").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))


@register(Q, SQL, f"""{FACTS_SQL} SELECT mode_id, cycle_broken, local_improvement, success, other_incomplete, count(*)::BIGINT AS n FROM facts GROUP BY ALL""")
def run_outcome(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("mode_id", "cycle_broken", "local_improvement", "success", "other_incomplete").agg(F.count("*").alias("n"))


@register(Q, SQL, """SELECT p_brand AS g, sum(p_size)::BIGINT AS cc_total, quantile_disc(p_size, 0.95)::BIGINT AS cc_p95, count(*) FILTER (p_size > 20)::BIGINT AS cc_over_20,
count(*) FILTER (p_size > 40)::BIGINT AS cc_over_40, count(*)::BIGINT AS functions, count(DISTINCT p_name)::BIGINT AS files FROM part GROUP BY ALL""")  # fmt: skip
def p95_nearest_rank(spark, sf_dir):
    from ..sources.quality import lizard_metrics

    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_size").cast("string").alias("_c0"), F.lit("").alias("_c5"), F.col("p_name").alias("_c6"))
    return lizard_metrics(p, "g")

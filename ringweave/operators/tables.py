"""Result tables over the run-level fact table.

A fact row is a run: mode_id, mode_label, mode_order, repo, cycle_id, language, cycle_size, 0/1 flags
(structurally_evaluable, behavior_preserved, cycle_broken, local_improvement, success, other_incomplete, ...) and
footprints (files_modified, chars_changed, explanation_chars). Each table is one pass with partial sums over the
facts; cells without runs come from a small scaffold of the dimensions. ``HEADERS`` has the column titles of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from .quantiles import LARGE, exact_quantiles

#: Fixed values.
HEADERS = {
    "configuration": "Configuration",
    "runs": "Runs",
    "behavior_pct": "Behavior preserved",
    "broken_pct": "Cycle broken",
    "local_pct": "Local improvement",
    "success_pct": "Success",
    "successes": "Successes",
    "evaluable": "Structurally evaluable",
    "incomplete": "Other incomplete",
    "structural_pct": "Structural imp.",
    "weakening_pct": "Weakening imp.",
    "none_pct": "No local improvement",
    "denominator": "Denominator",
    "any_pct": "Any global regression",
    "redundancy_pct": "Redundancy increase",
    "outside_pct": "New outside-target cyclic nodes",
    "both_pct": "Both criteria",
    "median_files": "Median files modified",
    "iqr_files": "IQR files modified",
    "median_chars": "Median chars changed",
    "iqr_chars": "IQR chars changed",
    "median_chars_success": "Median chars changed (succ. only)",
    "mean_expl": "Mean expl. chars",
    "median_expl": "Median expl. chars",
}


def flag(name: str) -> Column:
    return F.col(name) == 1


def _outcomes() -> list[Column]:
    return [
        F.count("*").alias("runs"),
        *[E.count_if(flag(f)).alias(n) for f, n in (("behavior_preserved", "b"), ("cycle_broken", "c"), ("local_improvement", "l"), ("success", "s"))],
    ]


def _shares(runs: Column | str = "runs") -> list[Column]:
    names = (("b", "behavior_pct"), ("c", "broken_pct"), ("l", "local_pct"), ("s", "success_pct"))
    return [E.pct(n, runs).alias(out) for n, out in names]


def main_results(facts: DataFrame) -> DataFrame:
    """Runs and shares of outcomes for each mode."""
    E.require_columns(facts, ["mode_id", "behavior_preserved", "cycle_broken", "local_improvement", "success"])
    return facts.groupBy("mode_id", F.col("mode_label").alias("configuration")).agg(*_outcomes()).select("mode_id", "configuration", "runs", *_shares())


def breakdown(facts: DataFrame, dims: list[str], fixed: dict[str, list[str]] | None = None) -> DataFrame:
    """Outcome shares by mode and further dimensions, empty cells kept.

    The values of a dimension are those in ``fixed`` or else those that occur; the cells are their cross product,
    which is as small as the result.
    """
    spark, fixed = facts.sparkSession, fixed or {}
    got = facts.groupBy("mode_id", *dims).agg(*_outcomes())
    # one more pass finds the values of all dimensions; their product is as large as the result
    free = [d for d in ("mode_id", *dims) if d not in fixed]
    cells = got.agg(*[F.collect_set(d).alias(d) for d in free])
    for d in free:
        cells = cells.withColumn(d, F.explode(d))
    for d in fixed:
        cells = cells.crossJoin(spark.createDataFrame([(v,) for v in fixed[d]], f"{d} string"))
    full = cells.join(got, ["mode_id", *dims], "left").withColumn("runs", F.coalesce("runs", F.lit(0)).cast("long"))
    return full.select("mode_id", *dims, "runs", *_shares())


def language_breakdown(facts: DataFrame) -> DataFrame:
    return breakdown(facts, ["language"])


def size_breakdown(facts: DataFrame) -> DataFrame:
    binned = facts.withColumn("cycle_size_bin", E.size_bin("cycle_size")).where("cycle_size_bin is not null")
    return breakdown(binned, ["cycle_size_bin"], {"cycle_size_bin": [b[2] for b in E.SIZE_BINS]})


def size_language_breakdown(facts: DataFrame) -> DataFrame:
    binned = facts.withColumn("cycle_size_bin", E.size_bin("cycle_size")).where("cycle_size_bin is not null")
    return breakdown(binned, ["cycle_size_bin", "language"], {"cycle_size_bin": [b[2] for b in E.SIZE_BINS]})


def repo_success(facts: DataFrame) -> DataFrame:
    """Runs and successes for each repository and mode, empty cells kept."""
    got = facts.groupBy("repo", "mode_id").agg(F.count("*").alias("runs"), E.count_if(flag("success")).alias("successes"))
    cells = got.agg(F.collect_set("mode_id").alias("mode_id"), F.collect_set("repo").alias("repo"))
    cells = cells.withColumn("repo", F.explode("repo")).withColumn("mode_id", F.explode("mode_id"))
    full = cells.join(got, ["repo", "mode_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select("repo", "mode_id", zero("runs"), zero("successes")).withColumn("success_pct", E.pct("successes", "runs"))


def run_accounting(facts: DataFrame) -> DataFrame:
    return facts.groupBy("mode_id").agg(
        F.count("*").alias("runs"), E.count_if(flag("structurally_evaluable")).alias("evaluable"), E.count_if(flag("other_incomplete")).alias("incomplete")
    )


def structural_decomposition(facts: DataFrame) -> DataFrame:
    """How the cycle-broken, behaviour-preserving, evaluable runs of a mode improved."""
    base = flag("structurally_evaluable") & flag("behavior_preserved") & flag("cycle_broken")
    structural, weakening = flag("structural_improvement_raw"), flag("weakening_improvement_raw")
    got = facts.groupBy("mode_id").agg(
        E.count_if(base).alias("denominator"),
        E.count_if(base & structural).alias("x"),
        E.count_if(base & weakening).alias("y"),
        E.count_if(base & ~structural & ~weakening).alias("z"),
    )
    return got.select("mode_id", "denominator", *[E.pct(a, "denominator").alias(b) for a, b in (("x", "structural_pct"), ("y", "weakening_pct"), ("z", "none_pct"))])


def regression_criteria(facts: DataFrame) -> DataFrame:
    """Which global regressions the behaviour-preserving, evaluable runs of a mode have."""
    base = flag("structurally_evaluable") & flag("behavior_preserved")
    more = F.col("post_global_redundancy") > F.col("baseline_global_redundancy")
    outside = flag("global_regression_outside_target_raw")
    tests = {"any_pct": flag("global_structural_regression_raw"), "redundancy_pct": more, "outside_pct": outside, "both_pct": more & outside}
    got = facts.groupBy("mode_id").agg(E.count_if(base).alias("denominator"), *[E.count_if(base & t).alias(f"n_{n}") for n, t in tests.items()])
    return got.select("mode_id", "denominator", *[E.pct(f"n_{n}", "denominator").alias(n) for n in tests])


def local_global(facts: DataFrame) -> DataFrame:
    """Locally improved runs, those with a global regression, and those of them outside the target."""
    local, worse = flag("local_improvement"), flag("global_structural_regression_raw")
    got = facts.groupBy("mode_id").agg(
        E.count_if(local).alias("improved"),
        E.count_if(local & worse).alias("regressed"),
        E.count_if(local & worse & flag("global_regression_outside_target_raw")).alias("outside"),
    )
    return got.select("mode_id", "improved", "regressed", "outside", E.pct("regressed", "improved").alias("regressed_pct"), E.pct("outside", "improved").alias("outside_pct"))


def _iqr(c: str) -> Column:
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    return F.round(q[1] - q[0], 6)


def edit_footprint(facts: DataFrame, most: int = LARGE) -> DataFrame:
    """Median and interquartile range of edits, exact and linear between values; modes without edits keep nulls.

    Modes of over ``most`` runs are selected from in rounds (``quantiles``), so that no task holds their distinct values.
    """
    won = F.when(flag("success"), F.col("chars_changed"))
    if facts.groupBy("mode_id").agg(F.count("*").alias("n")).where(F.col("n") > most).isEmpty():
        return facts.groupBy("mode_id").agg(
            F.median("files_modified").alias("median_files"), _iqr("files_modified").alias("iqr_files"), F.median("chars_changed").alias("median_chars"),
            _iqr("chars_changed").alias("iqr_chars"), F.median(won).alias("median_chars_success"),
        )
    measures = {"files": F.col("files_modified"), "chars": F.col("chars_changed"), "won": won}
    each = F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("v")) for k, c in measures.items()])
    long = facts.select("mode_id", F.explode(each).alias("x")).select("mode_id", "x.*")
    q = exact_quantiles(long, ["mode_id", "measure"], [0.25, 0.5, 0.75], most)
    of = lambda k, i: F.max(F.when(F.col("measure") == k, F.col("q")[i]))
    got = q.groupBy("mode_id").agg(
        of("files", 1).alias("median_files"), F.round(of("files", 2) - of("files", 0), 6).alias("iqr_files"), of("chars", 1).alias("median_chars"),
        F.round(of("chars", 2) - of("chars", 0), 6).alias("iqr_chars"), of("won", 1).alias("median_chars_success"),
    )
    return facts.select("mode_id").distinct().join(got, "mode_id", "left")


def explanation_length(facts: DataFrame) -> DataFrame:
    """Mean and median characters of explanations; modes without any have no row."""
    return facts.where("explanation_chars is not null").groupBy("mode_id").agg(
        F.bround(F.avg("explanation_chars"), 0).cast("long").alias("mean_expl"), F.bround(F.median("explanation_chars"), 0).cast("long").alias("median_expl")
    )


def cost_efficiency(facts: DataFrame, cost: str = "cost") -> DataFrame:
    """Mean and interquartile range of positive costs, of all runs and of successes."""
    known = F.when(F.col(cost) > 0, F.col(cost))
    won = F.when(flag("success"), known)
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    return facts.groupBy("mode_id").agg(
        F.round(F.avg(known), 6).alias("mean_cost"),
        F.round(q(known)[1] - q(known)[0], 6).alias("iqr_cost"),
        F.round(F.avg(won), 6).alias("mean_cost_success"),
        E.count_if(flag("success")).alias("successes"),
    )


def trajectory_summary(events: DataFrame, keys: list[str], limit: int = 150) -> DataFrame:
    """Of each run's trajectory events (response_id, is_finish): distinct responses, a finish, the limit reached."""
    return events.groupBy(*keys).agg(
        F.countDistinct("response_id").alias("responses"), F.coalesce(F.bool_or("is_finish"), F.lit(False)).alias("finished")
    ).withColumn("reached", F.col("responses") >= limit)


def iteration_limit(runs: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each mode that reached the limit of model responses, with and without an end of their own."""
    joined = runs.join(summary, keys, "left")
    got = joined.groupBy("mode_id").agg(
        F.count("*").alias("runs"),
        F.count("responses").alias("with_trajectory"),
        E.count_if(F.col("reached")).alias("reached"),
        E.count_if(F.col("reached") & ~F.col("finished")).alias("reached_unfinished"),
    )
    return got.withColumn("reached_pct", E.pct("reached", "runs")).withColumn("unfinished_pct", E.pct("reached_unfinished", "runs"))


def stale_risk(failed_runs: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Failed runs of each mode with each kind of finding (run keys, kind)."""
    kinds = ("stale_old_import", "stale_local_reference", "removed_import_used")
    per = findings.groupBy(*keys).agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in kinds])
    joined = failed_runs.join(per, keys, "left")
    any_kind = F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(F.col(k), F.lit(False)) for k in kinds]), F.lit(False))
    got = joined.groupBy("mode_id").agg(F.count("*").alias("runs"), *[E.count_if(F.col(k)).alias(k) for k in kinds], E.count_if(any_kind).alias("any_risk"))
    return got.withColumn("any_pct", E.pct("any_risk", "runs"))


def cycle_rates(facts: DataFrame) -> DataFrame:
    """Success of each cycle and mode: rate, successes, trials."""
    won = F.coalesce(F.col("success"), F.lit(0))
    return facts.groupBy("repo", "cycle_id", "mode_id").agg(
        F.avg(won.cast("double")).alias("rate"), F.sum(won).cast("long").alias("successes"), F.count("*").alias("trials")
    )


def paired_differences(rates: DataFrame, left: str, right: str) -> DataFrame:
    """Difference in success, in percentage points, of the cycles that both modes have."""
    a = rates.where(F.col("mode_id") == left).select("repo", "cycle_id", F.col("rate").alias("l"))
    b = rates.where(F.col("mode_id") == right).select("repo", "cycle_id", F.col("rate").alias("r"))
    return a.join(b, ["repo", "cycle_id"]).select("repo", "cycle_id", (F.lit(100.0) * (F.col("l") - F.col("r"))).alias("delta"))


FACTORS = {
    "Cycle centrality": ("cycle_centrality", E.centrality_bin),
    "Enclosing SCC size": ("baseline_scc_size", E.scc_bin),
    "Repository size": ("repo_dependency_graph_size", E.repo_bin),
    "Cycle external connectivity": ("cycle_external_edges", E.external_bin),
}


def structural_bins(facts: DataFrame, baseline: str, selected: str) -> DataFrame:
    """Cycles, runs and successes of two modes in each bin of four structural factors, in one pass."""
    of = lambda m: F.col("mode_id") == m
    names = ("b_runs", "s_runs", "b_won", "s_won")
    # first each cycle's sums, a row for each cycle as a rule, and only these rows are multiplied by the factors
    bins = [f(c).alias(f"f{i}") for i, (c, f) in enumerate(FACTORS.values())]
    cycles = facts.groupBy("repo", "cycle_id", *bins).agg(
        *[E.count_if(of(m)).alias(f"{n}_runs") for n, m in (("b", baseline), ("s", selected))],
        *[E.count_if(of(m) & flag("success")).alias(f"{n}_won") for n, m in (("b", baseline), ("s", selected))],
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"f{i}").alias("bin")) for i, n in enumerate(FACTORS)])).alias("p")
    binned = cycles.select("repo", "cycle_id", *names, pairs).select("repo", "cycle_id", *names, "p.factor", "p.bin").where("bin is not null")
    per = binned.groupBy("factor", "bin", "repo", "cycle_id").agg(*[F.sum(c).alias(c) for c in names])
    got = per.groupBy("factor", "bin").agg(F.count("*").alias("cycles"), *[F.sum(c).alias(c) for c in ("b_runs", "s_runs", "b_won", "s_won")])
    runs = F.when(F.col("b_runs") == F.col("s_runs"), F.col("b_runs").cast("string")).otherwise(F.concat_ws("/", "b_runs", "s_runs"))
    return got.select(
        "factor", "bin", "cycles", runs.alias("runs_per_configuration"), F.col("b_won").alias("baseline_successes"), E.pct("b_won", "b_runs").alias("baseline_pct"),
        F.col("s_won").alias("selected_successes"), E.pct("s_won", "s_runs").alias("selected_pct"),
    )


def difficulty_bins(rates: DataFrame, baseline: str, selected: str) -> DataFrame:
    """Cycles by the pooled success of two modes, in seven fixed bins, empty ones kept."""
    side = lambda m, p: rates.where(F.col("mode_id") == m).select("repo", "cycle_id", F.col("successes").alias(f"{p}w"), F.col("trials").alias(f"{p}t"))
    both = side(baseline, "b").join(side(selected, "s"), ["repo", "cycle_id"])
    pooled = F.lit(100.0) * (F.col("bw") + F.col("sw")) / (F.col("bt") + F.col("st"))
    got = both.groupBy(E.difficulty_bin(pooled).alias("bin")).agg(F.count("*").alias("cycles"), *[F.sum(c).alias(c) for c in ("bw", "bt", "sw", "st")])
    levels = rates.sparkSession.createDataFrame([(b,) for b in E.DIFFICULTY_BINS], "bin string")
    return levels.join(got, "bin", "left").select(
        "bin", F.coalesce("cycles", F.lit(0)).cast("long").alias("cycles"), E.pct("bw", "bt").alias("baseline_pct"), E.pct("sw", "st").alias("selected_pct")
    )


def characterise(rows: DataFrame, split: str, columns: list[str], digits: int = 2, most: int = LARGE) -> DataFrame:
    """Count, quartiles and range of each column in each split, and as formatted texts; exact at any size (``quantiles``)."""
    long = rows.select(split, F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(split, "x.property", "x.v")
    ends = exact_quantiles(long, ["property", split], [0.0, 0.25, 0.5, 0.75, 1.0], most)
    got = ends.select("property", split, "n", F.slice("q", 2, 3).alias("q"), F.col("q")[0].alias("lo"), F.col("q")[4].alias("hi"))
    r = lambda c: F.round(c, digits)
    return got.select(
        "property", split, "n", r(F.col("q")[0]).alias("q1"), r(F.col("q")[1]).alias("med"), r(F.col("q")[2]).alias("q3"), r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi")
    )


def with_texts(summary: DataFrame, digits: int = 2) -> DataFrame:
    """``characterise`` with the median, quartiles and range as texts."""
    f = lambda c: F.format_number(c, digits)
    return summary.withColumns(
        {"median_text": f("med"), "iqr_text": F.concat_ws("--", f("q1"), f("q3")), "range_text": F.concat_ws("--", f("lo"), f("hi"))}
    )


def size_grid(rows: DataFrame, split: str, size: str, splits: list[str], sizes: range) -> DataFrame:
    """How many rows each split has of each size, for every cell of the grid."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(s, n) for s in splits for n in sizes], f"{split} string, {size} int")
    got = rows.where(F.col(size).isNotNull()).groupBy(split, F.col(size).cast("int").alias(size)).agg(F.count("*").alias("n"))
    return grid.join(got, [split, size], "left").select(split, size, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def success_pivot(table: DataFrame, row: str, modes: list[str], value: str = "success_pct") -> DataFrame:
    """A column of values for each mode."""
    return table.groupBy(row).pivot("mode_id", modes).agg(F.first(value))


def repo_summary(repos: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Median, least and greatest of measures for each group and for all, by rollup."""
    aggs = [a for m in measures for a in (F.bround(F.median(m), 0).cast("long").alias(f"{m}_median"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))]
    got = repos.rollup(group).agg(F.count("*").alias("repositories"), *aggs, F.grouping(group).alias("_all"))
    return got.select(F.when(F.col("_all") == 1, "All").otherwise(F.col(group)).alias("grp"), *[c for c in got.columns if c not in (group, "_all")])


def external_top(edges: DataFrame, members: DataFrame, k: int = 20) -> DataFrame:
    """For each cycle, its most frequent outside neighbours: direction, node, count, place."""
    from pyspark.sql import Window

    src, dst = members.select("cycle_id", F.col("node").alias("src")), members.select("cycle_id", F.col("node").alias("dst"))
    out = edges.join(src, "src").join(dst, ["cycle_id", "dst"], "left_anti").select("cycle_id", F.lit("out").alias("direction"), F.col("dst").alias("node"))
    inn = edges.join(dst, "dst").join(src, ["cycle_id", "src"], "left_anti").select("cycle_id", F.lit("in").alias("direction"), F.col("src").alias("node"))
    got = out.unionByName(inn).groupBy("cycle_id", "direction", "node").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("cycle_id", "direction").orderBy(F.desc("n"), "node"))
    return got.withColumn("place", place).where(F.col("place") <= k)


def union_of_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of several tables, each with the name of its split."""
    return reduce(lambda a, b: a.unionByName(b), [rows.withColumn("split", F.lit(name)) for name, rows in parts.items()])


def selected_mode(facts: DataFrame, baseline: str = "no_explain") -> str | None:
    """The one mode that stands against the baseline; None where there is none or more than one."""
    modes = [r["mode_id"] for r in facts.where("mode_id is not null").select("mode_id").distinct().limit(3).collect()]
    others = [m for m in modes if m != baseline]
    return others[0] if baseline in modes and len(others) == 1 else None


def in_display_order(table: DataFrame, facts: DataFrame, *first: Column) -> DataFrame:
    """A table's rows by the given columns and then by the modes' order in the plan."""
    order = facts.groupBy("mode_id").agg(F.min("mode_order").alias("_o"))
    return table.join(order, "mode_id", "left").orderBy(*first, "_o").drop("_o")


def size_rank(label: Column | str) -> Column:
    """Place of a size bin among the fixed ones."""
    labels = F.array(*[F.lit(b[2]) for b in E.SIZE_BINS])
    return F.array_position(labels, E.col(label))

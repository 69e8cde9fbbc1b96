"""Paired comparisons with bootstrap intervals, and binomial models with random intercepts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stored
from . import tables

#: Comparisons of configurations: label, left mode, right mode. Fixed values.
PARADIGM = [
    ("Descriptive vs No-explanation", "explain_E0_S0_noaux", "no_explain"),
    ("Advisory vs No-explanation", "explain_E1_S1_noaux", "no_explain"),
    ("Directive vs No-explanation", "explain_E2_S2_noaux", "no_explain"),
    ("Descriptive vs Advisory", "explain_E0_S0_noaux", "explain_E1_S1_noaux"),
    ("Descriptive vs Directive", "explain_E0_S0_noaux", "explain_E2_S2_noaux"),
    ("Advisory vs Directive", "explain_E1_S1_noaux", "explain_E2_S2_noaux"),
]
AUXILIARY = [
    ("Advisory + boundary vs Advisory", "explain_E1_S1_boundary", "explain_E1_S1_noaux"),
    ("Advisory + graph vs Advisory", "explain_E1_S1_graph", "explain_E1_S1_noaux"),
    ("Directive + boundary vs Directive", "explain_E2_S2_boundary", "explain_E2_S2_noaux"),
    ("Directive + graph vs Directive", "explain_E2_S2_graph", "explain_E2_S2_noaux"),
]


def comparisons_of(modes: set[str]) -> list[tuple[str, str, str]]:
    return [c for c in PARADIGM + AUXILIARY if {c[1], c[2]} <= modes]


def seed_of(label: str) -> int:
    return 12345 + sum(map(ord, label))


def bootstrap_ci(values: np.ndarray, seed: int, n: int = 10_000, alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Percentile interval of the mean over ``n`` resamples, drawn in blocks from one stream."""
    if not len(values):
        return None, None
    rng = np.random.default_rng(seed)
    block = max(1, (1 << 22) // len(values))
    sizes = [min(block, n - at) for at in range(0, n, block)]
    means = np.concatenate([values[rng.integers(0, len(values), (k, len(values)))].mean(axis=1) for k in sizes])
    return float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))


def bounded_jitter(key: Column, center: Column, width: float, seed: int) -> Column:
    """A place around ``center``, at most ``width`` away, that the seed and the row's key decide: the same in each run."""
    share = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long").cast("double") / float(1 << 60)
    return center.cast("double") + width * (2.0 * share - 1.0)


def placeholders(facts: DataFrame, keys: list[str], baseline: str, selected: str, effects: list[str]) -> DataFrame:
    """Typed rows in place of a model, for each group of runs (mode_id, success) that none can be fitted to: keys, effect,
    coefficient and odds_ratio (null), p (n/a). Such a group lacks one of the modes, or a success, or a failure."""
    won = F.col("success") == 1
    of = lambda m: F.coalesce(F.bool_or(F.col("mode_id") == m), F.lit(False))
    fits = of(baseline) & of(selected) & F.coalesce(F.bool_or(won), F.lit(False)) & F.coalesce(F.bool_or(~won), F.lit(False))
    none = F.lit(None).cast("double")
    odd = facts.where(F.col("mode_id").isin(baseline, selected)).groupBy(*keys).agg(fits.alias("_fits")).where("not _fits")
    return odd.select(*keys, F.explode(F.array(*map(F.lit, effects))).alias("effect"), none.alias("coefficient"), none.alias("odds_ratio"), F.lit("n/a").alias("p"))


def compare_modes(facts: DataFrame, comparisons: list[tuple[str, str, str]], resamples: int = 10_000) -> DataFrame:
    """label, left_mode, right_mode, paired, delta and interval (percentage points, one digit) of each comparison.

    The cycles of a comparison, at most one row each, are one group; the comparisons run side by side.
    """
    spark = facts.sparkSession
    ship_package(spark)
    rates = tables.cycle_rates(facts)
    pairs = None
    for label, left, right in comparisons:
        one = tables.paired_differences(rates, left, right).select(F.lit(label).alias("label"), F.concat_ws("\0", "repo", "cycle_id").alias("cycle"), "delta")
        pairs = one if pairs is None else pairs.unionByName(one)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        values = pdf.sort_values("cycle")["delta"].to_numpy(dtype=float)
        lo, hi = bootstrap_ci(values, seed_of(label), resamples)
        return pd.DataFrame({"label": [label], "paired": [len(values)], "delta": [round(float(values.mean()), 1)], "ci_low": [round(lo, 1)], "ci_high": [round(hi, 1)]})

    named = spark.createDataFrame(comparisons, "label string, left_mode string, right_mode string")
    if pairs is None:
        return named.selectExpr("*", "0L paired", "double(null) delta", "double(null) ci_low", "double(null) ci_high")
    got = pairs.groupBy("label").applyInPandas(solve, "label string, paired long, delta double, ci_low double, ci_high double")
    return named.join(got, "label", "left").fillna(0, ["paired"])


def zscore_log1p(df: DataFrame, column: str, log: bool = True) -> DataFrame:
    """``df`` with ``z``: the column (by log1p) in standard deviations from its mean; null if they don't differ."""
    x = F.log1p(F.col(column).cast("double")) if log else F.col(column).cast("double")
    s = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn("z", F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s"))).drop("_m", "_s")  # one row


def _nodes(k: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Hermite places and weights for a standard normal variable."""
    x, w = np.polynomial.hermite_e.hermegauss(k)
    return x, w / w.sum()


#: Part of a sum of likelihoods that its rounding may take; less isn't told from nothing, however many groups it adds up.
NOISE = 1e-12


class Glmm:
    """Binomial model with a normal random intercept for each group, fitted by maximum likelihood.

    Rows are (group, successes, trials, predictors). With ``points`` of 1 the likelihood of a group is its Laplace
    approximation at the mode of its intercept, as mixed model packages have it by default; with more it is
    integrated by Gauss-Hermite quadrature. It is maximised by Newton steps with numerical derivatives on
    (coefficients, log standard deviations). ``outer`` names a larger group that each group lies in, with a random
    intercept of its own. ``weight`` says how many alike groups each group stands for.
    """

    def __init__(self, group, won, trials, x, outer=None, points: int = 1, weight=None, base: bool = True):
        self.names, self.g = np.unique(np.asarray(group), return_inverse=True)
        self.outer = None
        if outer is not None:
            of = np.unique(np.asarray(outer), return_inverse=True)[1]
            self.outer = np.zeros(len(self.names), dtype=int)
            self.outer[self.g] = of
        self.won, self.trials = np.asarray(won, float), np.asarray(trials, float)
        self.x = np.column_stack([np.ones(len(self.won)), np.asarray(x, float).reshape(len(self.won), -1)])
        self.times = np.ones(len(self.names))
        if weight is not None:
            self.times[self.g] = np.asarray(weight, float)
        self.base = self._constant() if base else 0.0
        self.points = points
        self.at, self.weight = _nodes(max(points, 2))

    def _constant(self) -> float:
        """What the likelihood has of the numbers of ways alone."""
        pairs, at = np.unique(np.stack([self.won, self.trials], axis=1), axis=0, return_inverse=True)
        ways = np.array([math.lgamma(t + 1) - math.lgamma(w + 1) - math.lgamma(t - w + 1) for w, t in pairs.tolist()])
        return float((ways[at.ravel()] * self.times[self.g]).sum())

    def _totals(self) -> tuple[int, float, float, bool]:
        """Coefficients, successes, trials, and whether there is an outer intercept."""
        times = self.times[self.g]
        return self.x.shape[1], float(self.won @ times), float(self.trials @ times), self.outer is not None

    def logliks(self, points: list[np.ndarray]) -> list[float]:
        return [self.loglik(p) for p in points]

    def loglik(self, p: np.ndarray) -> float:
        if self.points == 1:
            return self._laplace(p)
        if self.outer is not None:
            return self._nested(p)
        eta = (self.x @ p[:-1])[:, None] + math.exp(p[-1]) * self.at[None]
        ll = self.won[:, None] * eta - self.trials[:, None] * np.logaddexp(0, eta)
        per = np.zeros((len(self.names), len(self.at)))
        np.add.at(per, self.g, ll)
        top = per.max(axis=1)
        return float(self.times @ (top + np.log(np.exp(per - top[:, None]) @ self.weight))) + self.base

    def _laplace(self, p: np.ndarray) -> float:
        """At the joint mode of all intercepts (in standard deviations), found by Newton steps.

        The Hessian of one outer group is an arrow: diagonal in its groups' intercepts, with one row for its own.
        """
        n, nested = len(self.names), self.outer is not None
        k = self.x.shape[1]
        fixed, s, t = self.x @ p[:k], math.exp(p[k]), math.exp(p[k + 1]) if nested else 0.0
        of = self.outer if nested else np.zeros(n, dtype=int)
        m = int(of.max()) + 1
        u, v = np.zeros(n), np.zeros(m)

        def value(u, v):
            eta = fixed + s * u[self.g] + t * v[of][self.g]
            per = np.bincount(self.g, self.won * eta - self.trials * np.logaddexp(0, eta), minlength=n) - u * u / 2
            return eta, float(self.times @ per) - float(v @ v) / 2

        eta, now = value(u, v)
        for _ in range(100):
            q = 1 / (1 + np.exp(-eta))
            r = np.bincount(self.g, self.won - self.trials * q, minlength=n)
            w = np.bincount(self.g, self.trials * q * (1 - q), minlength=n)
            du, dv = s * r - u, t * np.bincount(of, self.times * r, minlength=m) - v
            a = 1 + s * s * w
            arrow = 1 + t * t * np.bincount(of, self.times * w / a, minlength=m)
            step_v = (dv - np.bincount(of, s * t * self.times * w * du / a, minlength=m)) / arrow if nested else np.zeros(m)
            step_u = (du - s * t * w * step_v[of]) / a
            size = 1.0
            while True:
                new_u, new_v = u + size * step_u, v + size * step_v
                new_eta, new = value(new_u, new_v)
                if new >= now - NOISE * max(1.0, abs(now)) or size < 1e-6:
                    break
                size /= 2
            u, v, eta, now = new_u, new_v, new_eta, new
            if max(np.abs(size * step_u).max(initial=0), np.abs(size * step_v).max(initial=0)) < 1e-10:
                break
        q = 1 / (1 + np.exp(-eta))
        w = np.bincount(self.g, self.trials * q * (1 - q), minlength=n)
        a = 1 + s * s * w
        det = self.times @ np.log(a) + (np.log(1 + t * t * np.bincount(of, self.times * w / a, minlength=m)).sum() if nested else 0.0)
        return now - float(det) / 2 + self.base

    def _nested(self, p: np.ndarray) -> float:
        eta = (self.x @ p[:-2])[:, None, None] + math.exp(p[-2]) * self.at[None, :, None] + math.exp(p[-1]) * self.at[None, None, :]
        ll = self.won[:, None, None] * eta - self.trials[:, None, None] * np.logaddexp(0, eta)
        k = len(self.at)
        per = np.zeros((len(self.names), k, k))
        np.add.at(per, self.g, ll)
        top = per.max(axis=1, keepdims=True)
        inner = top[:, 0] + np.log(np.einsum("gkr,k->gr", np.exp(per - top), self.weight))
        whole = np.zeros((self.outer.max() + 1, k))
        np.add.at(whole, self.outer, inner)
        top = whole.max(axis=1)
        return float((top + np.log(np.exp(whole - top[:, None]) @ self.weight)).sum()) + self.base

    def _slopes(self, p: np.ndarray, h: float = 1e-4):
        n, e = len(p), np.eye(len(p)) * h
        pairs = [(i, j) for i in range(n) for j in range(i)]
        f0, *f = self.logliks([p, *(p + a for a in e), *(p - a for a in e), *(p + e[i] + e[j] for i, j in pairs), *(p - e[i] - e[j] for i, j in pairs)])
        up, down, far, near = f[:n], f[n : 2 * n], f[2 * n : 2 * n + len(pairs)], f[2 * n + len(pairs) :]
        grad, hess = (np.array(up) - np.array(down)) / (2 * h), np.zeros((n, n))
        for i in range(n):
            hess[i, i] = (up[i] - 2 * f0 + down[i]) / h**2
        for (i, j), a, b in zip(pairs, far, near):
            hess[i, j] = hess[j, i] = (a - up[i] - up[j] + 2 * f0 - down[i] - down[j] + b) / (2 * h**2)
        return f0, grad, hess

    def fit(self, steps: int = 100):
        k, won, trials, nested = self._totals()
        p = np.zeros(k + 1 + nested)
        rate = (won + 0.5) / (trials + 1)
        p[0] = math.log(rate / (1 - rate))
        f0, grad, hess = self._slopes(p)
        for _ in range(steps):
            values, vectors = np.linalg.eigh(-hess)
            step = vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), 1e-3))
            step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            while True:  # the place that a step leads to is looked at whole, so that a good one costs nothing further
                to = np.clip(p + step, -30, 30)
                f, g, h = self._slopes(to)
                if f >= f0 - NOISE * abs(f0) or np.abs(step).max() < 1e-7:
                    break
                step /= 2
            gained, p, f0, grad, hess = f - f0, to, f, g, h
            if gained < max(1e-9, NOISE * abs(f0)) or np.abs(step).max() < 1e-7:  # a deviation that goes to zero gains less and less
                break
        self.p, self.ll = p, f0
        cov = np.linalg.pinv(-hess)
        self.se = np.sqrt(np.maximum(np.diag(cov), 0))
        self.variance = math.exp(2 * p[k])
        self.outer_variance = math.exp(2 * p[k + 1]) if nested else None
        return self


#: Distinct groups that one task adds up, at least.
TASK_GROUPS = 2_000
_ROWS = "array<struct<x:array<double>,won:double,trials:double>>"


def _model_of(units: pa.ListArray, predictors: int, nested: bool, base: bool = False) -> Glmm | None:
    """The model of some units: each a list of (rows, n), the groups of one outer group or a single group."""

    def spread(column):
        """Values of a list column, and which list each is of."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return column.flatten(), np.repeat(np.arange(len(n)), n)

    groups, outer = spread(units)
    rows, group = spread(groups.field("rows"))
    if not len(rows):
        return None
    number = lambda x: x.to_numpy(zero_copy_only=False)
    x = number(rows.field("x").flatten()).reshape(len(rows), predictors)
    return Glmm(group, number(rows.field("won")), number(rows.field("trials")), x, outer[group] if nested else None, weight=number(groups.field("n"))[group], base=base)


class PooledGlmm(Glmm):
    """The model of ``Glmm`` on groups that stay in Spark.

    ``units``: groups, ``array<struct<rows, n>>`` with rows ``array<struct<x, won, trials>>``: the groups of one outer
    group, or one group; n says how many alike groups one stands for. A likelihood is a sum over units, so a Newton step
    is one job in which each task adds up its units' likelihoods at all points that the step's derivatives need, and the
    driver adds up a row of them for each task. It holds nothing else of the data, and a task one batch of units.
    """

    def __init__(self, units: DataFrame, predictors: int, nested: bool = False):
        self.units, self.predictors, self.nested, self.base = units.select("groups"), predictors, nested, 0.0
        ship_package(units.sparkSession)
        self.base, self.sum_won, self.sum_trials, groups = self._sums(4, lambda m: [m._constant(), *m._totals()[1:3], len(m.names)])
        # a job's tasks are as many as there is work for
        self.units = self.units.coalesce(max(1, math.ceil(groups / TASK_GROUPS)))

    def _totals(self):
        return self.predictors + 1, self.sum_won, self.sum_trials, self.nested

    def _sums(self, n: int, of) -> list[float]:
        predictors, nested = self.predictors, self.nested

        def run(batches):
            total = np.zeros(n)
            for batch in batches:
                model = _model_of(batch.column(0), predictors, nested)
                if model is not None:
                    total += of(model)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        sums = self.units.mapInArrow(run, "s array<double>").agg(*[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(n)]).first()
        return [x or 0.0 for x in sums]

    def logliks(self, points: list[np.ndarray]) -> list[float]:
        return [x + self.base for x in self._sums(len(points), lambda m: [m.loglik(p) for p in points])]

    def loglik(self, p: np.ndarray) -> float:
        return self.logliks([p])[0]


def lrt_p(full: float, null: float) -> float:
    """p of a likelihood ratio with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, full - null)))


def format_p(p: float | None) -> str | None:
    return None if p is None else "<0.001" if p < 0.001 else f"{p:.3f}"


def odds_ratio(beta: float, se: float) -> tuple[float, float, float]:
    """Odds ratio and its Wald interval."""
    return math.exp(beta), math.exp(beta - 1.96 * se), math.exp(beta + 1.96 * se)


def _alike(rates: DataFrame, x: list[Column], keys: list[str], within: list[str]) -> DataFrame:
    """Groups (by ``keys``) of rows (successes, trials, predictors ``x``), those of equal rows once, with their number:
    within, rows, n."""
    rows = F.array_sort(F.collect_list(F.struct(F.array(*[c.cast("double") for c in x]).alias("x"), F.col("successes").cast("double").alias("won"), F.col("trials").cast("double").alias("trials"))))
    return rates.groupBy(*keys).agg(rows.alias("rows")).groupBy(*within, "rows").agg(F.count("*").cast("double").alias("n"))


def configuration_model(facts: DataFrame, baseline: str, selected: str, label: str = "Configuration") -> pd.DataFrame:
    """Effect of the selected configuration on success, with random intercepts for cycles.

    Cycles with the same outcomes in both modes are one group that stands for all of them; with an intercept for
    repositories too, those of one repository, so that a repository is a row of its distinct outcomes. Both stay in Spark.
    Rows are empty placeholders where there is nothing to fit (a mode is missing, no success or no failure).
    """
    rates = stored(tables.cycle_rates(facts.where(F.col("mode_id").isin(baseline, selected))), "cycle-rates")
    told = rates.agg(F.countDistinct("mode_id").alias("modes"), F.sum("successes").alias("won"), F.sum("trials").alias("trials"), F.countDistinct("repo").alias("repos")).first()
    effect, var, repo = label, "Cycle random-effect variance", "Repository random-effect variance"
    columns = ["effect", "coefficient", "odds_ratio", "ci", "p"]
    if told["modes"] < 2 or not 0 < told["won"] < told["trials"]:
        return pd.DataFrame([[x, None, None, None, None] for x in (effect, var, repo)], columns=columns)
    x, cycle = F.col("mode_id") == selected, ["repo", "cycle_id"]
    single = lambda x: stored(_alike(rates, x, cycle, []).select(F.array(F.struct("rows", "n")).alias("groups")), "model-units")
    full, null = PooledGlmm(single([x]), 1).fit(), PooledGlmm(single([]), 0).fit()
    ratio, lo, hi = odds_ratio(full.p[1], full.se[1])
    own = [effect, round(full.p[1], 3), round(ratio, 3), f"{lo:.3f}--{hi:.3f}", format_p(lrt_p(full.ll, null.ll))]
    # robustness: the same model with a random intercept for each repository too
    wide = None
    if told["repos"] > 1:
        within = _alike(rates, [x], cycle, ["repo"]).groupBy("repo").agg(F.collect_list(F.struct("rows", "n")).alias("groups"))
        wide = round(PooledGlmm(stored(within, "model-units"), 1, True).fit().outer_variance, 3)
    return pd.DataFrame([own, [var, round(full.variance, 3), None, None, None], [repo, wide, None, None, None]], columns=columns)


def single_factor_models(facts: DataFrame, selected: str, factors: dict[str, tuple[str, bool]]) -> pd.DataFrame:
    """A model for each structural factor (column, whether by log1p), z-scored over runs; failures give empty rows."""
    out = []
    for label, (column, log) in factors.items():
        own = zscore_log1p(facts.where(F.col(column).isNotNull()), column, log)
        sums = own.groupBy("repo", "cycle_id", "mode_id").agg(F.sum("success").alias("successes"), F.count("*").alias("trials"), F.avg("z").alias("z"))
        sums = stored(sums, "factor-sums")
        told = sums.agg(F.count(F.when(F.col("z").isNull(), 1)).alias("odd"), F.sum("successes").alias("won"), F.sum("trials").alias("trials")).first()
        try:
            if told["odd"] or not told["won"] or not 0 < told["won"] < told["trials"]:
                raise ValueError("nothing to fit")
            groups = _alike(sums, [F.col("z"), F.col("mode_id") == selected], ["repo", "cycle_id"], [])
            m = PooledGlmm(stored(groups.select(F.array(F.struct("rows", "n")).alias("groups")), "model-units"), 2).fit()
            ratio, lo, hi = odds_ratio(m.p[1], m.se[1])
            out.append([label, round(m.p[1], 3), round(ratio, 3), f"{lo:.3f}--{hi:.3f}"])
        except (ValueError, np.linalg.LinAlgError):
            out.append([label, None, None, None])
    return pd.DataFrame(out, columns=["factor", "coefficient", "odds_ratio", "ci"])

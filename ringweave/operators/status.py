"""Phase statuses of experiment units as an append-only log: latest state, resume, gates, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E

OUTCOMES = ("started", "ok", "failed", "skipped", "blocked")
BLOCKED_EXIT = 42


def latest(log: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key, with partial maxima and no sort."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")
    return log.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])


def to_run(units: DataFrame, log: DataFrame, keys: list[str], phase: str, valid: DataFrame | None = None) -> DataFrame:
    """Units whose last status of the phase isn't ok, or whose inputs and outputs are no longer ``valid`` (keys)."""
    done = latest(log.where(F.col("phase") == phase), keys, ["ts"], ["outcome"]).where("outcome = 'ok'").select(*keys)
    if valid is not None:
        done = done.join(valid, keys, "left_semi")
    return units.join(done, keys, "left_anti")


def gate(units: DataFrame, log: DataFrame, keys: list[str], before: str) -> DataFrame:
    """Units for which the phase before has ended well."""
    ok = latest(log.where(F.col("phase") == before), keys, ["ts"], ["outcome"]).where("outcome = 'ok'").select(*keys)
    return units.join(ok, keys, "left_semi")


def after_block(log: DataFrame, order: str = "ord", by: list[str] | None = None) -> DataFrame:
    """Rows that come after the first blocked one: with fail-fast there are none."""
    by = by or ["phase"]
    first = F.min(F.when(F.col("outcome") == "blocked", F.col(order))).over(Window.partitionBy(*by))
    return log.withColumn("_b", first).where(F.col(order) > F.col("_b")).drop("_b")


def resume_violations(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Units of two snapshots (outcome, mtime) that were complete and have changed, or were not and haven't."""
    b = before.select(*keys, F.col("outcome").alias("was"), F.col("mtime").alias("old"))
    both = b.join(after.select(*keys, F.col("mtime").alias("new")), keys, "left")
    same = F.col("old").eqNullSafe(F.col("new"))
    return both.withColumn("violation", F.when((F.col("was") == "ok") & ~same, "touched").when((F.coalesce("was", F.lit("")) != "ok") & same, "not run")).where("violation is not null")


def missing(units: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Units without their row in ``present``."""
    return units.join(present, keys, "left_anti")


def expect_metrics(units: DataFrame, refactor: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Units whose metrics outcome isn't what the refactoring's calls for: ok if committed, else skipped."""
    want = F.when(F.col("refactor") == "committed", "ok").otherwise("skipped")
    both = units.join(refactor.select(*keys, F.col("outcome").alias("refactor")), keys, "left").join(metrics.select(*keys, F.col("outcome").alias("metrics")), keys, "left")
    return both.withColumn("expected", want).where(~F.col("expected").eqNullSafe(F.col("metrics")))


def midrun_edits(logs: DataFrame, markers: tuple[str, str], text: str = "text") -> DataFrame:
    """Logs or patches that hold both markers."""
    return logs.where(F.col(text).contains(markers[0]) & F.col(text).contains(markers[1]))


def run_phase(units: list, phase: str, run, status, stop_on_blocked: bool = True) -> list:
    """Run a phase unit after unit: ``run(unit)`` gives (outcome, reason); ``status(row)`` appends to the log.

    Ends at the first blocked unit if asked to.
    """
    rows = []
    for i, unit in enumerate(units):
        status({"unit": unit, "phase": phase, "ord": i, "outcome": "started", "reason": ""})
        outcome, reason = run(unit)
        if outcome not in OUTCOMES:
            raise ValueError(f"no such outcome: {outcome}")
        rows.append({"unit": unit, "phase": phase, "ord": i, "outcome": outcome, "reason": reason})
        status(rows[-1])
        if stop_on_blocked and outcome == "blocked":
            break
    return rows


def skipped_rows(units: DataFrame, branches: DataFrame, keys: list[str], phase: str) -> DataFrame:
    """Status rows of units whose branch isn't there: the phase is skipped."""
    gone = missing(units, branches, keys)
    return gone.select(*keys, F.lit(phase).alias("phase"), F.lit("skipped").alias("outcome"), F.lit("missing_branch").alias("reason"))


def deletable(branch: Column | str, base: Column | str, experiment: Column | str) -> Column:
    """Whether a refactoring branch may be deleted: it has the experiment's prefix and isn't the base; false if unknown."""
    branch, base = E.col(branch), E.col(base)
    return F.coalesce((branch != base) & F.startswith(branch, F.concat(F.lit("atd-"), E.col(experiment), F.lit("-"))), F.lit(False))


def replay(outcomes: DataFrame, stop_on_blocked: bool = True) -> DataFrame:
    """The log that phases leave whose units (unit, phase, ord, outcome, reason) are run in order: a started row and one of
    the outcome for each, with seq counting on; nothing after a phase's first blocked unit, if it stops there.

    The last unit that runs is a partial minimum by phase, so no phase is gathered or sorted. An unknown outcome is an error.
    """
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("no such outcome: "), F.coalesce("outcome", F.lit("null")))))
    rows = outcomes.select("unit", "phase", "ord", known.alias("outcome"), "reason")
    if stop_on_blocked:
        first = rows.where("outcome = 'blocked'").groupBy("phase").agg(F.min("ord").alias("_first"))
        rows = rows.join(first, "phase", "left").where("_first is null or ord <= _first")
    pair = F.array(F.struct((F.col("ord") * 2).alias("seq"), F.lit("started").alias("outcome"), F.lit("").alias("reason")), F.struct((F.col("ord") * 2 + 1).alias("seq"), "outcome", "reason"))
    return rows.select("unit", "phase", "ord", F.explode(pair).alias("s")).select("unit", "phase", "ord", "s.*")


def digests(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and digest of what each unit has: SHA-256 over the paths and content digests of its files (path, text), in order.

    Contents are digested where they lie; what comes together is a unit's paths and digests.
    """
    one = F.concat_ws(":", "path", F.coalesce(F.sha2("text", 256), F.lit("missing")))
    return files.select(*keys, one.alias("_f")).groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_f")), ","), 256).alias("digest"))


def unchanged(recorded: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Units (keys) whose recorded digests are all as they are now: what ``to_run`` takes as ``valid``.

    recorded, now: keys, role (input or output) and digest. A role that has come or gone is a change.
    """
    both = recorded.select(*keys, "role", F.col("digest").alias("_was")).join(now.select(*keys, "role", F.col("digest").alias("_is")), [*keys, "role"], "full")
    same = F.bool_and(F.col("_was").eqNullSafe(F.col("_is")) & F.col("_was").isNotNull())
    return both.groupBy(*keys).agg(same.alias("_same")).where("_same").select(*keys)

"""Run artifacts: outcomes, trajectories, token usage, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E

EVENT = (
    "struct<action:string,tool_call_metadata:struct<function_name:string,model_response:struct<id:string>>,"
    "llm_metrics:struct<accumulated_token_usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>"
)


def outcome_of(status: Column | str) -> Column:
    """Outcome of a status document; empty where it is missing or odd."""
    return F.coalesce(F.trim(F.get_json_object(E.col(status), "$.outcome")), F.lit(""))


def trajectory_events(runs: DataFrame, keys: list[str], text: str = "trajectory") -> DataFrame:
    """keys, pos, response_id, is_finish of trajectories that are JSON lists; members that are no objects are dropped."""
    t = F.col(text)
    items = F.when(F.trim(t).startswith("["), F.from_json(t, "array<string>"))
    e = runs.select(*keys, F.posexplode(items).alias("pos", "x")).where(F.trim("x").startswith("{")).select(*keys, "pos", F.from_json("x", EVENT).alias("e"))
    finish = (F.col("e.action") == "finish") | (F.col("e.tool_call_metadata.function_name") == "finish")
    rid = F.col("e.tool_call_metadata.model_response.id")
    return e.select(*keys, "pos", F.when(rid != "", rid).alias("response_id"), F.coalesce(finish, F.lit(False)).alias("is_finish"))


def last_usage(text: Column | str) -> Column:
    """Accumulated tokens of the last entry of a trajectory."""
    last = F.try_element_at(F.from_json(E.col(text), f"array<{EVENT}>"), F.lit(-1))
    return last["llm_metrics"]["accumulated_token_usage"]


def usage_totals(records: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over the usage records of a transcript; a record without a total has that of its parts."""
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    own = records.where("event = 'usage'")
    return own.groupBy(*keys).agg(F.sum(p).alias("prompt_tokens"), F.sum(c).alias("completion_tokens"), F.sum(F.coalesce("total_tokens", p + c)).alias("total_tokens"))

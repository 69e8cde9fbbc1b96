"""Phase statuses as a stream of JSON files: duplicates dropped, outcomes counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts_utc timestamp, run_id string, phase string, outcome string, reason string, unit struct<repo:string,base_branch:string,branch:string,cycle_id:string,mode_id:string>"


def read_statuses(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Status rows as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).json(path)


def distinct_statuses(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row for each (run_id, phase, outcome); state older than the watermark is dropped."""
    return stream.withWatermark("ts_utc", late).dropDuplicatesWithinWatermark(["run_id", "phase", "outcome"])


def outcome_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Statuses by window, phase and outcome."""
    return stream.withWatermark("ts_utc", late).groupBy(F.window("ts_utc", window), "phase", "outcome").agg(F.count("*").alias("n"))


def first_blocked(stream: DataFrame) -> DataFrame:
    """Rows that should stop a run: the model could not be reached."""
    return stream.where("outcome = 'blocked' or reason = 'llm_unavailable'")

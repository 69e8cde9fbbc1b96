"""Text sources: repository and cycle lists, whole files, exit codes, logs, JSON and CSV documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as E


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Fields and place of the lines that are neither blank nor comments."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\\s+", " ")).alias("line"), F.monotonically_increasing_id().alias("ord"))
    return rows.where("line <> '' and not startswith(line, '#')").select("ord", "line", F.split("line", " ").alias("p"))


def _checked(parts: Column, least: int, what: str) -> Column:
    return F.when(F.size(parts) >= least, parts).otherwise(F.raise_error(F.concat(F.lit(f"a {what} line needs {least} fields: "), F.col("line"))))


def read_repos(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """repo, base_branch, entry, language, ord. Lenient: three fields do, and the language is then ``unknown``."""
    p = _fields(spark, path).select("ord", _checked(F.col("p"), 4 if strict else 3, "repository").alias("p"))
    return p.select(F.get("p", 0).alias("repo"), F.get("p", 1).alias("base_branch"), F.get("p", 2).alias("entry"), F.coalesce(F.get("p", 3), F.lit("unknown")).alias("language"), "ord")


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """repo, base_branch, cycle_id, cycle_ord of a list of selected cycles."""
    p = _fields(spark, path).select("ord", _checked(F.col("p"), 3, "cycle").alias("p"))
    return p.select(F.get("p", 0).alias("repo"), F.get("p", 1).alias("base_branch"), F.get("p", 2).alias("cycle_id"), F.col("ord").alias("cycle_ord"))


def selected_cycles(spark: SparkSession, path: str, repo: str, branch: str) -> DataFrame:
    """Distinct cycle ids of one repository and branch, from lines of exactly three fields."""
    p = _fields(spark, path).where("size(p) = 3")
    return p.where((F.get("p", F.lit(0)) == repo) & (F.get("p", F.lit(1)) == branch)).select(F.get("p", F.lit(2)).alias("cycle_id")).distinct()


def read_whole(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path and text of whole files, folders below included."""
    r = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.json") -> DataFrame:
    """path and doc of JSON files; a file that doesn't parse or isn't an object has a null doc."""
    own = read_whole(spark, path, pattern)
    return own.select("path", F.when(F.trim("text").startswith("{"), F.from_json("text", schema, {"mode": "PERMISSIVE"})).alias("doc"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; empty cells are null."""
    r = spark.read.option("header", True).option("nullValue", "").option("nanValue", "__none__")
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def read_int_file(text: Column | str) -> Column:
    """The whole number that a small file holds; null if it holds anything else."""
    return F.trim(F.regexp_replace(E.col(text), "\\s+", " ")).try_cast("int")


def find_readmes(listing: DataFrame, most_depth: int = 6) -> DataFrame:
    """README files (path relative to the root), nearest first: path, place."""
    from pyspark.sql import Window

    name = F.lower(F.element_at(F.split("path", "/"), -1))
    own = listing.where(name.rlike("^readme.*\\.md$") & (E.path_depth("path") <= most_depth))
    keys = [c for c in listing.columns if c == "repo"]
    w = Window.partitionBy(*keys).orderBy(E.path_depth("path"), "path")
    return own.withColumn("place", F.row_number().over(w))


def pick_project(listing: DataFrame) -> DataFrame:
    """For each repo the shortest ``.sln`` path, else the shortest ``.csproj``; ties by path."""
    kind = F.when(F.col("path").rlike("(?i)\\.sln$"), 0).when(F.col("path").rlike("(?i)\\.csproj$"), 1)
    own = listing.withColumn("k", kind).where("k is not null")
    return own.groupBy("repo").agg(F.min(F.struct("k", F.length("path").alias("n"), "path"))["path"].alias("path"))


def cycle_files(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts of a cycle's files (repo, path, text) by node id; missing ones are left out."""
    return nodes.join(files.select("repo", F.col("path").alias("node"), "text"), ["repo", "node"])


def source_files(listing: DataFrame, skip: tuple[str, ...] = (".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist")) -> DataFrame:
    """Python files of a listing outside folders that hold none of the project's own."""
    return listing.where(F.col("path").endswith(".py") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))


def scan_files(before: DataFrame, after: DataFrame, changed: DataFrame, unknown: DataFrame, keys: list[str]) -> DataFrame:
    """Files to look at after a patch: before and after together, without those that can't be told or are gone."""
    gone = changed.select(*keys).join(after.select(*keys), keys, "left_anti")
    return before.select(*keys).union(after.select(*keys)).distinct().join(unknown.select(*keys), keys, "left_anti").join(gone, keys, "left_anti")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place of their first appearance."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def github_repos(repos: DataFrame, stars: int = 1000, loc: int = 4000, days: int = 365) -> DataFrame:
    """Repositories (stars, loc_nonblank, last_commit, today) that qualify."""
    return repos.where((F.col("stars") >= stars) & (F.col("loc_nonblank") >= loc) & (F.datediff("today", "last_commit") <= days))

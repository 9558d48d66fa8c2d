"""Readers of the engine's tables (one Parquet file or folder each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, lazily; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The change log, one row per sha: of repeated rows the one loaded first. Blank or null authors count as `(none)`.
    `ts, sha` order commits totally; size is the length of the message, status its sort."""
    c = table(spark, folder, "commits").where("sha is not null").groupBy("sha").agg(F.min_by(F.struct("author", "ts", "message"), "ingested_at").alias("x"))
    message = F.coalesce("message", F.lit(""))
    status = F.when(message.startswith("Merge"), "merge").when(message.startswith("fix"), "fix").otherwise("other")
    return c.select("sha", "x.*").select("sha", F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit("(none)")).alias("author"), "ts", "message", F.length(message).cast("double").alias("size"), status.alias("status"))


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of files, one row per (sha, path): repeated rows count once, null paths are left out, null counts are 0. Rows move once,
    by sha, for both steps and for joins with commits."""
    c = table(spark, folder, "file_changes").where("path is not null and sha is not null").repartition("sha").distinct()
    return c.groupBy("sha", "path").agg(F.sum(F.coalesce("additions", F.lit(0))).alias("additions"), F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The indexed files: complexity is the sum over a file's symbols of the greatest measured one (null if none is), loc the
    last line seen."""
    y = table(spark, folder, "symbols").groupBy("file_path", "symbol_name").agg(F.max("cyclomatic_complexity").alias("c"), F.max("end_line").alias("e"))
    f = y.groupBy(F.col("file_path").alias("path")).agg(F.sum("c").alias("complexity"), F.max("e").cast("bigint").alias("loc"))
    return f.select("path", F.substring_index("path", "/", -1).alias("name"), F.substring_index("path", ".", -1).alias("language"), F.substring_index("path", "/", 1).alias("component"), "complexity", "loc")


def blame(spark: SparkSession, folder: str) -> DataFrame:
    """Line authorship: the lines that each author added to each file, and when."""
    j = file_changes(spark, folder).join(commits(spark, folder).select("sha", "author", "ts"), "sha")
    return j.groupBy("path", "author").agg(F.sum("additions").alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

"""Cutting lineage so that losing an executor loses nothing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode only: on a cluster the
    executors would not share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there; its parents are forgotten."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, for costly Python stages: rows move only if the scan has fewer partitions than there are cores, that
    is, if the input is a few small files; large inputs stay where they are."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df  # asking for its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df

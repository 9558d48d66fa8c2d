"""An extension beyond batch analyses: churn of a stream of file changes, by event time, tolerating late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_churn(changes: DataFrame, at: str = "ts", window: str = "7 days", late: str = "2 days") -> DataFrame:
    """Changes and changed lines of each path in each window; rows later than `late` are dropped, state is bounded by it.

    Null paths and times make no rows. Works on batch tables as well, without dropping anything.
    """
    c = changes.where(F.col("path").isNotNull() & F.col(at).isNotNull())
    if changes.isStreaming:
        c = c.withWatermark(at, late)
    w = c.groupBy(F.window(at, window).alias("w"), "path").agg(F.count("*").alias("changes"), F.sum(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("changed_lines"))
    return w.select(F.col("w.start").alias("start"), "path", "changes", "changed_lines")


def start(changes: DataFrame, folder: str, checkpoint: str, **kw):
    """Append finished windows to a folder, exactly once across restarts."""
    return windowed_churn(changes, **kw).writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sync points of runs over streams: totals of tumbling windows, late rows within a watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_totals(rows: DataFrame, interval: str, late: str = "10 minutes") -> DataFrame:
    """From rows (ts, series, value), stored or streamed: one row per series and interval: sync (its start in seconds), n, rain, peak."""
    source = rows.withWatermark("ts", late) if rows.isStreaming else rows
    g = source.groupBy(F.window("ts", interval).alias("w"), "series").agg(F.count("*").alias("n"), F.sum("value").alias("rain"), F.max("value").alias("peak"))
    return g.select("series", F.unix_seconds("w.start").alias("sync"), "n", "rain", "peak")


def run_stream(rows: DataFrame, interval: str, folder: str, checkpoint: str, late: str = "10 minutes"):
    """Appends closed intervals to a table, exactly once; returns the started query."""
    return sync_totals(rows, interval, late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()

"""Incremental statistics over streams of blocks or events: windows with a watermark, exactly-once sinks by batch number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    """With a watermark if it is a stream; those need a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and type. Works on a stream (with a watermark, so state is bounded) and on a table alike."""
    e = _marked(events, late)
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = _marked(events, late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes each batch to its own folder; a repeated batch overwrites its folder, so results are exactly once."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()

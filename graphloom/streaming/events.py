"""Streaming forms: turns without repeats, and pattern counts by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_turns(turns: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Turns without repeats of (session_id, turn_index, role) within the watermark's delay."""
    return turns.withWatermark(at, delay).dropDuplicatesWithinWatermark(["session_id", "turn_index", "role"])


def pattern_counts(events: DataFrame, at: str = "ts", pattern: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window start, pattern, n), final once the watermark has passed a window."""
    counted = events.withWatermark(at, delay).groupBy(F.window(at, width), F.col(pattern).alias("pattern")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "pattern", "n")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to parquet files, and stops; the checkpoint makes the next run go on."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q

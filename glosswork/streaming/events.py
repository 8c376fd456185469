"""Structured Streaming: resumable work loops and idempotency windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.session import scratch

__all__ = ["drain", "first_in_window", "scratch", "windowed_counts", "work_loop"]


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now and stops; a second run goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_in_window(events: DataFrame, key: list[str], time: str, window: str) -> DataFrame:
    """One event per key within the window after the watermark."""
    return events.withWatermark(time, window).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, size: str, late: str, by: str) -> DataFrame:
    """Counts per time window and kind, emitted once the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def work_loop(pending: DataFrame, work, checkpoint: str) -> None:
    """Calls work(batch, batch_id) for each micro-batch; a batch id that comes again must give the same result."""
    pending.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

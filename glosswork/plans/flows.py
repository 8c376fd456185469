"""Streaming queries over the events table: the stream equals the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.plans.registry import query
from glosswork.streaming import events as S


def _stream(t):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")


@query("m01_resumable_loop", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def resumable_loop(t):
    out = S.scratch(t.spark, "out")

    def work(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    S.work_loop(_stream(t).select("event_type", "value"), work, S.scratch(t.spark, "check"))
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("m02_idempotency_window", "SELECT count(DISTINCT event_id) AS n FROM events")
def idempotency_window(t):
    out = S.scratch(t.spark, "out")
    S.drain(S.first_in_window(_stream(t).select("event_id", F.col("ts").cast("timestamp").alias("ts")), ["event_id"], "ts", "24 hours"), out, S.scratch(t.spark, "check"))
    return t.spark.read.parquet(out).agg(F.count("*").alias("n"))

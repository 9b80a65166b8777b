"""Streaming queries, run over all events that have arrived (extensions: the reference has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import events
from .registry import query


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY ALL")
def stream_tumbling_stats(spark: SparkSession, d: str) -> DataFrame:
    stream = events.tumbling(events.event_stream(spark, f"{d}/events.parquet"), "event_type", "value")
    return events.drain(stream, "complete").selectExpr("cast(start as timestamp_ntz) as start", "event_type", "n", "mean", "least", "most")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_incremental_sums(spark: SparkSession, d: str) -> DataFrame:
    stream = events.incremental_sums(events.event_stream(spark, f"{d}/events.parquet"), "user_id")
    return events.drain(stream, "complete").selectExpr("user_id", "n", "round(total, 4) as total")

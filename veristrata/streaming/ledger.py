"""Extensions: the event ledger as a stream. Each equals its batch query once all events are in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows; events later than the watermark are dropped, and state with them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def latest_by_key(events: DataFrame) -> DataFrame:
    """The last state of each reservation, kept as running state by the engine (output mode: update or complete)."""
    at = F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    return events.groupBy("user_id").agg(at).select("user_id", F.col("m.event_type").alias("state"), F.col("m.event_id").alias("event_id"))

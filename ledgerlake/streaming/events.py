"""Streaming. The batch cycles of records run incrementally; event-time windows are an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, users and value by window and type, the same of a stream as of a table. (extension)

    Users are counted exactly: a window's state holds each of its users once.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    users = F.size(F.collect_set("user_id")).cast("long")
    value = F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 4)
    out = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), users.alias("users"), value.alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "users", "value")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Events by sliding window. (extension)"""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select("window.start", "window.end", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events by user session. (extension)"""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once within the watermark. (extension)"""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stop: the re-entrant form of a cycle. (CYC-04, CYC-06, CYC-08)"""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """work(batch, number) for what is there now; a number that was done is not done again. (CYC-03, CYC-06)"""
    stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

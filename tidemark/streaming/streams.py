"""Structured Streaming forms of the store's asynchronous parts; each transformation also takes a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access_counts(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Accesses of each row by window of event time: log has ts and memory_id."""
    counts = log.withWatermark("ts", late).groupBy(F.window("ts", window), "memory_id").agg(F.count("*").alias("accesses"))
    return counts.select(F.col("window.start").alias("since"), "memory_id", "accesses")


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user that no event continues within the gap: they wait for being finalised."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("idle_from"), "events")


def reservations(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first request of each (scope, key)."""
    if requests.isStreaming:
        return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scope", "key"])
    from tidemark.operators.snapshots import earliest

    return earliest(requests, "scope", "key", order="ts")


def due_tasks(tasks: DataFrame, now: str, limit: int = 10) -> DataFrame:
    """The tasks that a tick takes: those pending and due, oldest first."""
    due = (F.col("status") == "pending") & (F.col("due_at") <= F.lit(now).cast("timestamp"))
    return tasks.filter(due).orderBy("due_at", "task_id").limit(limit)


def every(stream: DataFrame, interval: str, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls work on each micro-batch; one that takes longer than the interval delays the next, it never overlaps."""
    return stream.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(work).start()


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a finite stream gives out until nothing is left, as a table in memory: for tests and backfills."""
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)

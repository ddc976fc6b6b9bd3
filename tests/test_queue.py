"""The queue as a stream: a lost worker, retries, a third failure, and a restart between."""

import datetime as dt

import pytest

from tidemark.streaming import queue

SCHEMA = "task_id string, kind string, ts timestamp, due_at timestamp, most int, worker string, error string"
BASE = dt.datetime(2024, 1, 1)


def at(minute):
    return BASE + dt.timedelta(minutes=minute)


BATCHES = [
    [("a", "enqueue", at(0), None, None, None, None), ("b", "enqueue", at(1), None, None, None, None), ("c", "enqueue", at(2), at(60), 1, None, None), ("a", "lease", at(3), None, None, "w1", None), ("b", "lease", at(3), None, None, "w1", None), ("c", "lease", at(3), None, None, "w1", None)],
    [("b", "fail", at(4), None, None, "w1", "e1"), ("b", "lease", at(5), None, None, "w2", None), ("b", "fail", at(5), None, None, "w1", "not its worker"), ("x", "done", at(5), None, None, "w1", None)],
    [("tick", "enqueue", at(9), None, None, None, None), ("b", "fail", at(9), None, None, "w2", "e2")],
    [("a", "done", at(10), None, None, "w1", None), ("a", "lease", at(11), None, None, "w3", None), ("b", "lease", at(11), None, None, "w3", None)],
    [("a", "done", at(12), None, None, "w3", None), ("b", "fail", at(13), None, None, "w3", "e3"), ("a", "lease", at(14), None, None, "w3", None), ("c", "lease", at(61), None, None, "w1", None)],
]


def test_queue(spark, tmp_path):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    queue.use_store(spark)
    try:
        source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
        spark.createDataFrame([], SCHEMA).write.parquet(source)
        for batch in BATCHES:  # each run is a restart from the checkpoint
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            run = queue.changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            assert run.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    found = spark.read.parquet(out)
    told = {}
    for r in sorted(found.collect(), key=lambda r: (r.at, r.retries)):
        told.setdefault(r.task_id, []).append((r.status, r.retries, int((r.at - BASE).total_seconds() // 60)))
    # the worker of a says nothing for five minutes, so its news of minute 10 comes too late
    assert told["a"] == [("pending", 0, 0), ("processing", 0, 3), ("pending", 0, 8), ("processing", 0, 11), ("completed", 0, 12)]
    assert told["b"] == [("pending", 0, 1), ("processing", 0, 3), ("pending", 1, 4), ("processing", 1, 5), ("pending", 2, 9), ("processing", 2, 11), ("failed", 3, 13)]
    assert told["c"] == [("pending", 0, 2), ("processing", 0, 61)] and "x" not in told
    assert {r.task_id: r.error for r in queue.latest(found).collect()}["b"] == "e3"
    assert [r.task_id for r in queue.due(found, "2024-01-01 00:20:00").collect()] == ["tick"]


@pytest.mark.parametrize("now, want", [("2024-01-01 00:30:00", ["p", "q"]), ("2024-01-01 02:00:00", ["p", "q", "r"])])
def test_first_due_first(spark, now, want):
    rows = [("q", "pending", 0, at(5), at(5), at(5), None, None), ("p", "pending", 0, at(6), at(2), at(2), None, None), ("r", "pending", 0, at(60), at(7), at(7), None, None), ("s", "completed", 0, at(0), at(0), at(3), None, None), ("s", "pending", 0, at(0), at(0), at(0), None, None)]
    assert [r.task_id for r in queue.due(spark.createDataFrame(rows, queue.CHANGES), now).collect()] == want

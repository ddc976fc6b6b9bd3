"""A task queue as a stream: one state for each task, leases with timers, retries and a return of what a lost worker held."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, retries int, most int, due_at long, created_at long, lease long, worker string, error string"
CHANGES = "task_id string, status string, retries int, due_at timestamp, created_at timestamp, at timestamp, worker string, error string"
#: A lease without news goes back after five minutes; a task is tried three times.
STALE_MS, MOST_TRIES = 5 * 60_000, 3
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tasks(StatefulProcessor):
    """pending -> processing -> completed, or pending again after a failure or a lost lease, or failed after the last try.

    Events of a task count in the order of their time; one that doesn't fit the task's status, or comes from a
    worker whose lease is gone, changes nothing.
    """

    def __init__(self, stale_ms: int = STALE_MS):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.task = handle, handle.getValueState("task", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r.ts, r.kind)):
            now = int(row.ts.timestamp() * 1000)
            task = self._read()
            if row.kind == "enqueue" and task is None:
                task = {"status": "pending", "retries": 0, "most": row.most if row.most is not None else MOST_TRIES, "due_at": int((row.due_at or row.ts).timestamp() * 1000), "created_at": now, "lease": 0, "worker": None, "error": None}
            elif row.kind == "lease" and task and task["status"] == "pending" and task["due_at"] <= now:
                task |= {"status": "processing", "lease": now, "worker": row.worker}
                self.handle.registerTimer(now + self.stale_ms)
            elif row.kind in ("done", "fail") and task and task["status"] == "processing" and task["worker"] == row.worker:
                self.handle.deleteTimer(task["lease"] + self.stale_ms)
                if row.kind == "done":
                    task |= {"status": "completed"}
                else:
                    tried = task["retries"] + 1
                    task |= {"status": "pending" if tried < task["most"] else "failed", "retries": tried, "error": row.error, "worker": None}
            else:
                continue
            yield self._write(key, task, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        task, now = self._read(), expiredTimerInfo.getExpiryTimeInMs()
        if task and task["status"] == "processing" and task["lease"] + self.stale_ms == now:
            yield self._write(key, task | {"status": "pending", "worker": None}, now)

    def close(self) -> None:
        pass

    def _read(self) -> dict | None:
        if not self.task.exists():
            return None
        return dict(zip((f.split()[0] for f in STATE.split(", ")), self.task.get()))

    def _write(self, key, task: dict, now: int) -> Row:
        import datetime

        self.task.update(tuple(task.values()))
        when = lambda ms: datetime.datetime.fromtimestamp(ms / 1000)
        return Row(task_id=key[0], status=task["status"], retries=task["retries"], due_at=when(task["due_at"]), created_at=when(task["created_at"]), at=when(now), worker=task["worker"], error=task["error"])


def use_store(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def changes(events: DataFrame, stale_ms: int = STALE_MS, late: str = "0 seconds") -> DataFrame:
    """Each change of a task's status. events: a stream of task_id, kind (enqueue, lease, done, fail), ts, due_at, most (tries), worker, error.

    Time is that of the events: a lease goes back once the watermark has passed it by stale_ms.
    """
    rows = events.select("task_id", "kind", "ts", "due_at", "most", "worker", "error").withWatermark("ts", late)
    return rows.groupBy("task_id").transformWithState(Tasks(stale_ms), CHANGES, "append", "eventTime")


def latest(found: DataFrame) -> DataFrame:
    """Each task's last change."""
    return found.groupBy("task_id").agg(F.max_by(F.struct(*(c for c in found.columns if c != "task_id")), F.struct("at", "retries", F.col("status") != "pending")).alias("now")).select("task_id", "now.*")


def due(found: DataFrame, now: str, limit: int = 10) -> DataFrame:
    """What a tick may lease: the tasks that are pending and due, the oldest first."""
    return latest(found).filter((F.col("status") == "pending") & (F.col("due_at") <= F.lit(now).cast("timestamp"))).orderBy("created_at", "task_id").limit(limit)

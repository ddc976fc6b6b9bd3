"""Registered streaming operators, run here over batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.streaming import streams

query("str_access", "access_log", "SELECT memory_id, CAST(epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS since, count(*) AS accesses FROM access_log GROUP BY 1, 2")(lambda v: streams.access_counts(v.access_log.withColumn("ts", F.col("ts").cast("timestamp"))).select("memory_id", F.unix_micros("since").alias("since"), "accesses"))
query("str_session", "", "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS since, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session")(lambda v: streams.idle_sessions(v.events.withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.unix_micros("since").alias("since"), "events"))
query("str_idem", "", "SELECT event_type AS scope, CAST(user_id AS STRING) AS key, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us FROM events GROUP BY 1, 2")(lambda v: streams.reservations(v.events.select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))).select("scope", "key", F.unix_micros("ts").alias("first_us")))
query("str_queue", "", "SELECT event_id AS task_id FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 10")(lambda v: streams.due_tasks(v.events.select(F.col("event_id").alias("task_id"), F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("due_at")), "2024-01-15 00:00:00").select("task_id"))
query("str_cursor", "", "SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS byte_offset FROM conversations GROUP BY conv_id")(lambda v: v.conversations.groupBy("conv_id").agg(F.sum(F.octet_length("text").cast("long")).alias("byte_offset")))
query("str_ticker", "", "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS tick, count(*) AS due FROM events GROUP BY 1")(lambda v: v.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("due")).select(F.unix_micros("w.start").alias("tick"), "due"))

"""Queries on streams: visits by timers, whole results, merged batches, and a source of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.json_lines import json_lines
from sparkloom.sources.scratch import shared_folder
from sparkloom.sources.tables import stream, table
from sparkloom.streaming import sinks, visits, windows


@query("""
WITH marked AS (SELECT user_id, ts, event_type, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, count(DISTINCT event_type) AS kinds, CAST(s AS BIGINT) AS nth FROM numbered GROUP BY user_id, s
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def streamed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that timers have closed, numbered by user; those the watermark has not passed stay open."""
    events = windows.event_time(stream(spark, sf_dir, "events"), "ts", "1 hour")
    return windows.run_to_files(visits.visits(events, "user_id", "ts", "event_type", 1800))


@query("""
WITH w AS (SELECT date_trunc('day', ts) + INTERVAL 12 HOUR * CAST(k AS INT) + INTERVAL 12 HOUR * CAST(extract(HOUR FROM ts) >= 12 AS INT) - INTERVAL 12 HOUR AS started, event_type
FROM events, (SELECT unnest([0, 1]) AS k))
SELECT started, event_type, count(*) AS n FROM w GROUP BY started, event_type""")
def streamed_whole_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows in complete mode, open ones included, held by the memory sink: a row for each half day and kind."""
    events = windows.event_time(stream(spark, sf_dir, "events"), "ts", "1 hour")
    return sinks.complete_in_memory(windows.tumbling(events, "ts", "1 day", ["event_type"], slide="12 hours"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total, max(ts) AS last_ts FROM events GROUP BY user_id, event_type")
def streamed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals in update mode, merged batch by batch into a keyed table."""
    events = stream(spark, sf_dir, "events")
    totals = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last_ts"))
    found = sinks.merged(totals, "user_id long, event_type string, n long, total double, last_ts timestamp_ntz", ["user_id", "event_type"])
    return found.withColumn("total", F.round("total", 6))


_JSON_EVENTS = "event_id long, user_id long, event_type string, value double, props string"


def _as_lines(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark, "lines")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props").write.json(folder)
    return folder


@query("SELECT event_id, user_id, event_type, value, props FROM events WHERE event_type = 'click' AND value > 25")
def clicks_from_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines by our own source, in byte splits, with both filters pushed into it."""
    lines = json_lines(spark, _as_lines(spark, sf_dir), _JSON_EVENTS, splitBytes=str(1 << 20))
    return lines.where("event_type = 'click' and value > 25")


@query("SELECT event_id, user_id, value FROM events WHERE value <= 50")
def streamed_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same source as a stream, a few files a batch."""
    lines = json_lines(spark, _as_lines(spark, sf_dir), _JSON_EVENTS, stream=True, maxFilesPerTrigger="2")
    return windows.run_limited_to_files(lines.where("value <= 50").select("event_id", "user_id", "value"))

"""Streaming queries (R1-R5) driven to completion over the landed events
file; each returns the sink table as a DataFrame.  Their batch SQL
equivalents emit exactly the days the watermark has closed
(day end ≤ max(ts) − delay)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as S
from ..streaming import stream as R
from .registry import register

_CLOSED = "CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


def _events_stream(spark, sf):
    schema = S.table(spark, sf, "events").schema
    return R.stream_rows(spark, sf, schema, "events.parquet")


@register("stream_daily", f"""
SELECT CAST(ts AS DATE) AS "Date", event_type, round(avg(value), 6) AS value, count(*) AS n
FROM events WHERE {_CLOSED} GROUP BY 1, 2""")
def stream_daily(spark, sf):
    daily = R.stream_daily(_events_stream(spark, sf), ["value"], "mean", "1 day", keys=["event_type"])
    path = R.run_to_table(daily, "daily")
    return spark.read.parquet(path).select("Date", "event_type", F.round("value", 6).alias("value"), "n")


@register("stream_dedup", "SELECT DISTINCT props AS id FROM events")
def stream_dedup(spark, sf):
    s = _events_stream(spark, sf).withColumnRenamed("props", "id")
    path = R.run_to_table(R.stream_insert_new(s, "id", "1 day").select("id"), "dedup")
    return spark.read.parquet(path)


@register("stream_publish", f"""
SELECT CAST(ts AS DATE) AS "Date", round(avg(value), 6) AS value FROM events
WHERE event_type = 'purchase' AND {_CLOSED} GROUP BY 1""")
def stream_publish(spark, sf):
    s = _events_stream(spark, sf).filter(F.col("event_type") == "purchase")
    daily = R.stream_daily(s, ["value"], "mean", "1 day").select("Date", "value")
    target = R.work_dir(spark, "published")
    R.stream_publish(daily, target)
    # replaying the same days must not add rows (idempotent publish)
    R.stream_publish(R.stream_daily(_events_stream(spark, sf).filter(F.col("event_type") == "purchase"),
                                    ["value"], "mean", "1 day").select("Date", "value"), target, name="replay")
    return spark.read.parquet(target).select("Date", F.round("value", 6).alias("value"))


@register("stream_decay", f"""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS "Date", avg(value) AS value FROM events WHERE {_CLOSED} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY "Date") AS rn FROM d)
SELECT a.event_type, a."Date", round(sum(b.value * exp(-(a.rn - b.rn) / 7.0)), 6) AS "Cum_value"
FROM r a JOIN r b ON a.event_type = b.event_type AND b.rn <= a.rn GROUP BY 1, 2""")
def stream_decay(spark, sf):
    daily = R.stream_daily(_events_stream(spark, sf), ["value"], "mean", "1 day", keys=["event_type"])
    path = R.run_to_table(daily, "daily_for_decay")
    # second stage: the closed days, read as a stream in arrival order
    schema = spark.read.parquet(path).schema
    days = spark.readStream.schema(schema).parquet(path)
    out = R.run_to_table(R.stream_decay(days, "event_type", "value"), "decay")
    return spark.read.parquet(out).select("event_type", "Date", F.round("Cum_value", 6).alias("Cum_value"))

"""Batch forms of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.session import table
from tabulon.streaming.resume import windowed_rates


def windowed_error_rates(spark, d):
    e = table(spark, d, "events").select("ts", "user_id", (F.col("event_type") == "error").alias("failed"))
    done = windowed_rates(e, "ts", "user_id", "failed", "1 day")
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "user_id", "rows", "hits", "rate")


QUERIES = {"windowed_error_rates": windowed_error_rates}
ORACLE = {
    "windowed_error_rates": """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS hits, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate
FROM events GROUP BY 1, 2"""
}

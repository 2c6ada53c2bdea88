"""Streams: tasks resumed from a checkpoint, windowed rates of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new_files(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``work`` once on every file that came since the last call and appends its rows to parquet; then stops.

    The checkpoint makes each file count once, also after a failure.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    return work(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, time: str, key: str, flag: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and share of ``flag`` by key and time window; rows later than the watermark are dropped by a stream, not by a batch."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", late)
    by = timed.groupBy(F.window("__t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("hits"))
    return by.select(F.col("w.start").alias("start"), key, "rows", "hits", F.round(F.try_divide("hits", "rows"), 6).alias("rate"))

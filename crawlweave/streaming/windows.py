"""Windowed rates and progress on streams. Event time with a watermark makes them replayable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlweave.operators.messages import error_windows
from crawlweave.operators.metrics import average_by_window, success_rate, throughput
from crawlweave.operators.task_jobs import job_progress


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; files may hold one without zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def error_rates(
    events: DataFrame, ts: str, failed: Column, window: str = "5 minutes", slide: str = "1 minute",
    delay: str = "10 minutes",
) -> DataFrame:
    return error_windows(with_event_time(events, ts, delay), ts, failed, window, slide)


def success_rates(events: DataFrame, ts: str, ok: Column, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return success_rate(with_event_time(events, ts, delay), ts, ok, window)


def per_minute(events: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    return throughput(with_event_time(events, ts, delay), ts)


def score_average(events: DataFrame, ts: str, value: str, window: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    return average_by_window(with_event_time(events, ts, delay), ts, value, window)


def request_counts(events: DataFrame, key: str, ts: str, limit: int, delay: str = "10 minutes") -> DataFrame:
    """Requests per key and minute with how many pass the limit."""
    return (
        with_event_time(events, ts, delay)
        .groupBy(key, F.window(ts, "1 minute").alias("w")).agg(F.count("*").alias("requests"))
        .select(key, F.col("w.start").alias("minute"), "requests", F.least("requests", F.lit(limit)).alias("allowed"))
    )


def progress(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Job progress kept up to date; write it in ``complete`` or ``update`` mode."""
    return job_progress(tasks, as_of)


def to_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append closed windows to a Parquet folder."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def refresh(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the whole aggregate anew with each micro-batch, under its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()

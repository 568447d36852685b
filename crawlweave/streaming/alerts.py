"""Alerts on streams that fire once a condition has held for a time, and consumer lag of closed time.

Windows are aggregated first; the closed ones go into keyed state with event-time timers, a few rows for each key and
window however many events there are. ``operators.messages.held_for`` gives the same on a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crawlweave.functions.times import micros
from crawlweave.streaming.state import ROCKS


class HeldFor(StatefulProcessor):
    """Per key: since when the condition has held. ``step`` and ``hold`` are microseconds.

    ``over``: the state is the running sum of the values and the condition is that it exceeds this; a window without a row
    then changes nothing. Otherwise rows bring the condition, and a missing window ends the run.
    """

    def __init__(self, step: int, hold: int, over: int | None = None):
        self.step, self.hold, self.over = step, hold, over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, since long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, since, total = self.run.get() if self.run.exists() else (None, None, 0.0)
        found = []
        closed = pd.concat(list(rows)).sort_values("t")  # one row a window
        for t, value, flag in zip(closed["t"].tolist(), closed["value"].tolist(), closed["flag"].tolist(), strict=True):
            if self.over is not None:
                total += value
                value, flag = total, total > self.over
            elif last is not None and t != last + self.step:
                since = None
            since = (t if since is None else since) if flag else None
            last = t
            found.append((*key, t, float(value), since is not None and t - since >= self.hold))
        self.run.update((last, since, total))
        if self.over is None:  # once the next window has closed without a row, nothing is left to remember
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((last + 2 * self.step) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(found, columns=["key", "t", "value", "alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "t": pd.Series([], dtype="int64"), "value": pd.Series([], dtype=float), "alert": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def held_windows(windows: DataFrame, key: Column, value: Column, flag: Column, step: str, hold: str, over: int | None = None) -> DataFrame:
    """(key, window_start, value, alert) of the closed windows ``w`` of a streamed aggregate."""
    spark = windows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = windows.select(
        key.cast("string").alias("key"), F.window_time("w").alias("at"), F.unix_micros("w.start").alias("t"), value.cast("double").alias("value"), flag.alias("flag")
    )
    held = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=HeldFor(micros(spark, step), micros(spark, hold), over), outputStructType="key string, t long, value double, alert boolean",
        outputMode="Append", timeMode="EventTime",
    )
    return held.select("key", F.timestamp_micros("t").alias("window_start"), "value", "alert")


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def held_errors(
    events: DataFrame, ts: str, failed: Column, rate: float = 0.1, window: str = "5 minutes", slide: str = "1 minute", hold: str = "2 minutes",
    key: Column | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """Windows with their error rate; ``alert`` where it has been above ``rate`` in every window of the last ``hold``."""
    by = F.lit("all") if key is None else key
    windows = _timed(events, ts, delay).groupBy(by.cast("string").alias("_key"), F.window(ts, window, slide).alias("w")).agg(
        (F.count_if(failed) / F.count(F.lit(1))).alias("rate")
    )
    return held_windows(windows, F.col("_key"), F.col("rate"), F.col("rate") > rate, slide, hold)


def held_low_average(
    events: DataFrame, ts: str, value: Column, below: float = 0.5, window: str = "15 minutes", slide: str = "5 minutes", hold: str = "10 minutes",
    key: Column | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """Windows with their average; ``alert`` where it has been under ``below`` in every window of the last ``hold``."""
    by = F.lit("all") if key is None else key
    windows = _timed(events, ts, delay).groupBy(by.cast("string").alias("_key"), F.window(ts, window, slide).alias("w")).agg(F.avg(value).alias("mean"))
    return held_windows(windows, F.col("_key"), F.col("mean"), F.coalesce(F.col("mean") < below, F.lit(False)), slide, hold)


def held_backlog(
    changes: DataFrame, queue: str, ts: str, delta: Column, over: int = 1000, window: str = "1 minute", hold: str = "5 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Queue length after each window with changes; ``alert`` where it has been over ``over`` for ``hold``."""
    windows = _timed(changes, ts, delay).groupBy(F.col(queue).alias("_key"), F.window(ts, window).alias("w")).agg(F.sum(delta).alias("change"))
    return held_windows(windows, F.col("_key"), F.col("change"), F.lit(False), window, hold, over)


def consumer_lag_windows(
    published: DataFrame, acked: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", keys: Sequence[str] = ("queue",)
) -> DataFrame:
    """Per queue and closed window of publishing: messages published, acknowledged since, and still open.

    ``published`` has the keys, ``id`` and ``ts``; ``acked`` has the keys, ``id``, ``ts`` of publishing and ``acked_at``. Both sides carry a
    watermark, so an unacknowledged message leaves the join's state, as open, once acknowledgements of its time have passed by.
    """
    left = _timed(published, "ts", delay).select(*keys, "id", "ts")
    right = _timed(acked, "acked_at", delay).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_id"), "acked_at")
    same = (F.col("id") == F.col("_id")) & (F.col("acked_at") >= F.col("ts")) & (F.col("acked_at") <= F.col("ts") + F.expr(f"interval {window}"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    joined = left.join(right, same, "leftOuter")
    return joined.groupBy(*keys, F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("published"), F.count("_id").alias("acked")
    ).select(*keys, F.col("w.start").alias("window_start"), "published", "acked", (F.col("published") - F.col("acked")).alias("open"))

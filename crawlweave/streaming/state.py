"""State carried over micro-batches: smoothed response time, token bucket, stalled tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from crawlweave.operators.limits import TokenBucket
from crawlweave.operators.source_health import KEEP, response_ema

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ema_stream(
    requests: DataFrame, order: list[str], out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Smoothed response time per source after each micro-batch, as table versions below ``out``.

    A batch reduces to one row per source before it meets the state, so a hot source is
    as cheap as any other. Starting from ``old`` the average is
    old * 0.8^n + (average of the batch alone with its first value at ordinary weight).
    Version n+1 reads version n; a replayed batch overwrites its own version.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = response_ema(batch, order)
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{out}/version={number - 1}")
            renamed = old.select("source", F.col("requests").alias("_n"), F.col("ema").alias("_ema"))
            after = response_ema(batch, order, first_full=False).select("source", F.col("ema").alias("_tail"))
            fresh = (
                fresh.join(after, "source").join(renamed, "source", "full")
                .select(
                    "source",
                    (F.coalesce("requests", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("requests"),
                    F.when(F.col("requests").isNull(), F.col("_ema"))
                    .when(F.coalesce("_ema", F.lit(0.0)) == 0, F.col("ema"))
                    .otherwise(F.col("_ema") * F.pow(F.lit(KEEP), F.col("requests")) + F.col("_tail"))
                    .alias("ema"),
                )
            )
        fresh.write.mode("overwrite").parquet(f"{out}/version={number}")

    w = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def latest_version(spark: SparkSession, out: str) -> DataFrame:
    versions = spark.read.parquet(out)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).drop("version")


def token_bucket_stream(requests: DataFrame, key: str, ts: str, rate: float = 10.0, burst: int = 20) -> DataFrame:
    """Requests let through per key and micro-batch; the bucket level is kept in state.

    Requests of one instant are counted together first, then sorted by time inside the
    micro-batch; the source's rate limit bounds how many instants one key can bring.
    """
    op = TokenBucket(rate, burst)

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sums = [b.groupby("t", as_index=False)["n"].sum() for b in batches]
        b = pd.concat(sums).groupby("t", as_index=False)["n"].sum().sort_values("t")
        start = list(state.get) if state.exists else None
        passed, end = op.run(b["t"].to_numpy(), b["n"].to_numpy(), start)
        state.update(tuple(int(x) for x in end))
        yield pd.DataFrame(
            {"key": [k[0]], "requests": [int(b["n"].sum())], "allowed": [int(np.sum(passed))]}
        )

    ticks = requests.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.lit(1).alias("n")
    )
    return ticks.groupBy("key").applyInPandasWithState(
        step, "key string, requests long, allowed long", "last long, level long", "append", "NoTimeout"
    )


class Stalled(StatefulProcessor):
    """Per task: since when it has been processing. Updates are taken in the order of their times, so micro-batches don't matter."""

    def __init__(self, after: int):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, found = self.started.get()[0] if self.started.exists() else None, []
        updates = pd.concat([b[["t", "busy"]] for b in rows]).sort_values(["t", "busy"], ascending=[True, False])
        for t, busy in zip(updates["t"].tolist(), updates["busy"].tolist(), strict=True):
            if started is not None and t - started > self.after:
                found.append(started)
            started = t if busy else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if started is None:
            self.started.clear()
        else:
            self.started.update((started,))
            self.handle.registerTimer(max((started + self.after) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(key, [self.started.get()[0]] if self.started.exists() else [])
        self.started.clear()

    @staticmethod
    def _rows(key, found: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(found), dtype="object"), "started_us": pd.Series(found, dtype="int64")})

    def close(self) -> None:
        pass


def stalled_stream(updates: DataFrame, key: str, ts: str, after_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """(key, started_us) of tasks that stay in processing for longer than ``after_ms`` of event time, each time they do.

    State is one instant for each task in processing and its timer; both go when the task is done or reported.
    """
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = updates.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    rows = timed.select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(ts).alias("t"), (F.col("status") == "processing").alias("busy"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Stalled(after_ms * 1000), outputStructType="key string, started_us long", outputMode="Append", timeMode="EventTime"
    )

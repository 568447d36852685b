"""Message flow on streams: consume, acknowledge by checkpoint, retry, dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlweave.operators.messages import with_outcome


def read_stream(
    spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, fmt: str = "parquet",
    glob: str | None = None,
) -> DataFrame:
    """An append-only folder as a stream. The query's checkpoint is its acknowledged position."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def run_flow(
    messages: DataFrame, out: str, checkpoint: str, failed: Column, service: str, as_of: Column | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Write every micro-batch below ``out``, with ``outcome`` (ok, retry, dead) as a partition; ``read_flow`` reads it.

    The source is scanned once for a batch. It is written under its number and its number is committed afterwards, so readers
    see a batch as a whole or not at all, and a replay after a failure overwrites what was not committed.
    """
    now = as_of if as_of is not None else F.current_timestamp()

    def write(batch: DataFrame, number: int) -> None:
        with_outcome(batch, failed, service, now).write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/data/batch={number}")
        batch.sparkSession.range(number, number + 1).write.mode("overwrite").parquet(f"{out}/commits/batch={number}")

    w = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def read_flow(spark: SparkSession, out: str) -> DataFrame:
    """All committed messages with ``outcome`` and ``batch``; a filter on ``outcome`` reads only its folders."""
    done = spark.read.parquet(f"{out}/commits").select(F.col("batch").alias("_done"))  # a row a batch
    rows = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")
    return rows.join(F.broadcast(done), F.col("batch") == F.col("_done"), "left_semi")


def first_in_ttl(requests: DataFrame, key: str, ts: str, ttl: str = "1 hour") -> DataFrame:
    """Requests that pass: the first of a key, and each that comes a time-to-live or more after the last that passed.

    State is the last passing time of a key; it goes once the watermark is a time-to-live past it. Requests of one
    micro-batch are sorted by time; those whose key's last passing time is too close are let go block by block.
    """
    hold = requests.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {ttl})")).first()[0]

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat([b if last is None else b[b["_t"] >= last + hold] for b in batches]).sort_values("_t", kind="stable")
        t, passed = rows["_t"].to_numpy(), []
        at = 0
        while at < len(t):
            passed.append(at)
            last = int(t[at])
            at = int(t.searchsorted(last + hold))
        if passed:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + hold) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
            yield rows.iloc[passed].drop(columns=["_t", "_key"])

    timed = requests.filter(F.col(ts).isNotNull()).withWatermark(ts, ttl)
    timed = timed.withColumns({"_t": F.unix_micros(F.col(ts).cast("timestamp")), "_key": F.col(key)})
    return timed.groupBy("_key").applyInPandasWithState(step, requests.schema, "last long", "append", "EventTimeTimeout")

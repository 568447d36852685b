"""Queues as tables: retry, dead letters, trimming, lag, backlog and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.operators.ordered import number_rows


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds before the given attempt: min(base * factor^attempt, most)."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))


def retry_schedule(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """Remaining attempts of each message with the delay before each and the time it is due
    when every attempt fails at once."""
    left = F.when(
        F.col("retry_count") < F.col("max_retries"), F.sequence(F.col("retry_count") + 1, F.col("max_retries"))
    ).otherwise(F.array().cast("array<int>"))
    waits = F.transform(left, lambda a: retry_delay(a))
    return (
        messages.select("id", ts, F.posexplode(left).alias("_i", "attempt"), waits.alias("_w"))
        .withColumn("delay_seconds", F.get("_w", F.col("_i")))
        .withColumn("_total", F.aggregate(F.slice("_w", 1, F.col("_i") + 1), F.lit(0.0), lambda a, x: a + x))
        .withColumn(
            "due_at",
            F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_total").cast("decimal(18,6)")),
        )
        .select("id", "attempt", "delay_seconds", "due_at")
    )


def with_outcome(messages: DataFrame, failed: Column, service: str, as_of: Column) -> DataFrame:
    """Each message with its ``outcome`` and the columns of ``split_outcomes``, null where they don't apply."""
    bad, spent = F.coalesce(failed, F.lit(False)), F.col("retry_count") >= F.col("max_retries")
    outcome = F.when(~bad, "ok").when(spent, "dead").otherwise("retry")
    again, dead = bad & ~spent, bad & spent
    return messages.withColumns({
        "outcome": outcome, "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "delay_seconds": F.when(again, retry_delay(F.col("retry_count") + 1)), "service": F.when(dead, F.lit(service)),
        "failed_at": F.when(dead, as_of), "error": F.when(dead, F.lit("Max retries exceeded")),
    })


def split_outcomes(messages: DataFrame, failed: Column, service: str, as_of: Column) -> dict[str, DataFrame]:
    """ok, retry and dead tables of one batch. Retries carry their count, so the limit is reached."""
    spent = F.col("retry_count") >= F.col("max_retries")
    return {
        "ok": messages.filter(~failed),
        "retry": messages.filter(failed & ~spent).withColumn("retry_count", F.col("retry_count") + 1)
        .withColumn("delay_seconds", retry_delay(F.col("retry_count"))),
        "dead": messages.filter(failed & spent)
        .withColumn("service", F.lit(service))
        .withColumn("failed_at", as_of)
        .withColumn("error", F.lit("Max retries exceeded")),
    }


def outcome_label(failed: Column) -> Column:
    """Same split as one column, for counting."""
    spent = F.col("retry_count") >= F.col("max_retries")
    return F.when(~failed, "ok").when(spent, "dead").otherwise("retry")


def fail_jobs_of(dead: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs with a dead message become failed."""
    hit = dead.select("job_id").distinct().withColumn("_dead", F.lit(True))
    return (
        jobs.join(hit, "job_id", "left")
        .withColumn("completed_at", F.when(F.col("_dead"), as_of).otherwise(F.col("completed_at")))
        .withColumn("status", F.when(F.col("_dead"), "failed").otherwise(F.col("status")))
        .drop("_dead")
    )


def requeue(dead: DataFrame, queue: DataFrame) -> DataFrame:
    """Dead messages go back with their count reset."""
    return queue.unionByName(dead.select(*queue.columns).withColumn("retry_count", F.lit(0)))


def trim(messages: DataFrame, maxlen: int = 100_000, queue: str = "queue", order=("ts", "id")) -> DataFrame:
    """The last ``maxlen`` messages of each queue."""
    numbered = number_rows(messages, [queue], list(order), "_rn", descending=True)
    return numbered.filter(F.col("_rn") <= maxlen).drop("_rn")


def publish_order(messages: DataFrame, queue: str = "queue", order=("_rank", "ts", "id")) -> DataFrame:
    """Position of every message in its queue: high priority first, then oldest."""
    ranked = messages.withColumn("_rank", -F.col("priority"))
    return number_rows(ranked, [queue], list(order), "position").drop("_rank")


def queue_stats(messages: DataFrame, acked: Column, backlog: int = 1000, queue: str = "queue") -> DataFrame:
    return (
        messages.groupBy(queue)
        .agg(
            F.count("*").alias("published"),
            F.count_if(acked).alias("processed"),
            F.count_if(~acked).alias("length"),
        )
        .withColumn("backlog", F.col("length") > backlog)
    )


def consumer_lag(published: DataFrame, acked: DataFrame, queue: str = "queue", seq: str = "seq") -> DataFrame:
    """Last published minus last acknowledged per queue and consumer."""
    top = published.groupBy(queue).agg(F.max(seq).alias("last_published"))
    done = acked.groupBy(queue, "consumer").agg(F.max(seq).alias("last_acked"), F.count("*").alias("processed"))
    return done.join(top, queue).withColumn("lag", F.col("last_published") - F.col("last_acked"))


def backlog_series(changes: DataFrame, ts: str, delta: Column, window: str = "5 minutes", queue: str = "queue") -> DataFrame:
    """Queue length at the end of each window from +1 / -1 changes.

    Changes are summed per window first; the running part sees one row per queue and window.
    """
    per = (
        changes.groupBy(queue, F.window(ts, window).alias("w")).agg(F.sum(delta).alias("change"))
        .select(queue, F.col("w.start").alias("window_start"), "change")
    )
    w = W.partitionBy(queue).orderBy("window_start").rowsBetween(W.unboundedPreceding, 0)
    return per.withColumn("length", F.sum("change").over(w))


def held(df: DataFrame, condition: Column, ts: str, windows: int, keys=(), out: str = "alert") -> DataFrame:
    """True where ``condition`` has been true in the last ``windows`` rows of the series.

    Meant for windowed aggregates, whose row count per key is bounded by time.
    """
    w = W.partitionBy(*keys).orderBy(ts).rowsBetween(-(windows - 1), 0)
    hit = F.count_if(condition).over(w) == windows
    return df.withColumn(out, hit)


def held_for(df: DataFrame, condition: Column, ts: str, step: str, hold: str, keys=(), gaps: bool = True, out: str = "alert") -> DataFrame:
    """True where ``condition`` has been true in every window of the last ``hold``, by the windows' times.

    ``step`` lies between the starts of windows; a missing window ends a run unless ``gaps`` is false. Rows are windowed
    aggregates; with keys that hold very many windows, each run's rows still are spread by (keys, run).
    """
    order = W.partitionBy(*keys).orderBy(ts)
    before = F.lag(ts).over(order)
    broken = ~F.coalesce(condition, F.lit(False)) | (F.lit(gaps) & (before + F.expr(f"interval {step}") != F.col(ts)))
    runs = df.withColumn("_end", F.coalesce(broken, F.lit(False)).cast("int")).withColumn("_run", F.sum("_end").over(order.rowsBetween(W.unboundedPreceding, 0)))
    met = F.coalesce(condition, F.lit(False))
    runs = runs.withColumn("_since", F.min(F.when(met, F.col(ts))).over(W.partitionBy(*keys, "_run")))
    long_enough = F.col(ts) - F.expr(f"interval {hold}") >= F.col("_since")
    return runs.withColumn(out, met & F.coalesce(long_enough, F.lit(False))).drop("_end", "_run", "_since")


def error_windows(events: DataFrame, ts: str, failed: Column, window: str, slide: str, keys=()) -> DataFrame:
    """Sliding windows with total, errors and error rate."""
    return (
        events.groupBy(*keys, F.window(ts, window, slide).alias("w"))
        .agg(F.count("*").alias("total"), F.count_if(failed).alias("errors"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "errors",
                (F.col("errors") / F.col("total")).alias("error_rate"))
    )


def circuit_breaker(events: DataFrame, ts: str, failed: Column, keys=(), rate: float = 0.5) -> DataFrame:
    """Windows of 2 minutes every 30 seconds; the circuit is open where more than ``rate`` of the calls fail."""
    return error_windows(events, ts, failed, "2 minutes", "30 seconds", keys).withColumn(
        "open", F.col("error_rate") > rate
    )


def by_action(messages: DataFrame, known: tuple[str, ...] = ("ingest_file",)) -> dict[str, DataFrame]:
    """Messages per handler; unknown actions go to ``rejected``."""
    out = {a: messages.filter(F.col("action") == a) for a in known}
    out["rejected"] = messages.filter(~F.coalesce(F.col("action").isin(*known), F.lit(False)))
    return out

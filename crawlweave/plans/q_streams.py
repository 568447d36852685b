"""Streaming queries: the events table as a stream, run to its end, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.operators import messages as MS
from crawlweave.plans import views as V
from crawlweave.plans.registry import query, table
from crawlweave.session import fresh_path
from crawlweave.sources import versioned as VT
from crawlweave.streaming import alerts as AL
from crawlweave.streaming import queue as QU
from crawlweave.streaming import state as ST
from crawlweave.streaming import windows as WI


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _closed(spark, df, label):
    out = fresh_path(spark, label)
    WI.to_table(df, out, fresh_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out)


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


# a window is closed once the watermark (last event - 10 minutes) has passed its end
def closed(start, length):
    return f"{start} + INTERVAL {length} <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("stream_success_rate", f"""SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1)
WHERE {closed('window_start', '5 MINUTE')}""")
def stream_success_rate(spark, d):
    s = WI.success_rates(event_stream(spark, d), "ts", F.col("event_type") != "error")
    return _ntz(_closed(spark, s, "success").select("window_start", "total", "ok"), "window_start")


@query("stream_error_rates", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i) AS window_start, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors
  FROM events, range(5) r(i) GROUP BY 1) SELECT * FROM w WHERE {closed('window_start', '5 MINUTE')}""")
def stream_error_rates(spark, d):
    s = WI.error_rates(event_stream(spark, d), "ts", F.col("event_type") == "error")
    return _ntz(_closed(spark, s, "errors").select("window_start", "total", "errors"), "window_start")


@query("stream_throughput", f"SELECT * FROM (SELECT date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY 1) WHERE {closed('window_start', '1 MINUTE')}")
def stream_throughput(spark, d):
    return _ntz(_closed(spark, WI.per_minute(event_stream(spark, d), "ts"), "throughput"), "window_start")


@query("stream_score_average", f"""SELECT window_start, round(a, 6) AS avg_value, n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, avg(value) AS a, count(value) AS n FROM events GROUP BY 1)
WHERE {closed('window_start', '15 MINUTE')}""")
def stream_score_average(spark, d):
    a = _closed(spark, WI.score_average(event_stream(spark, d), "ts", "value"), "score")
    return _ntz(a.withColumn("avg_value", F.round("avg_value", 6)), "window_start")


@query("stream_rate_limit", f"""SELECT * FROM (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS requests, least(count(*), 1) AS allowed FROM events GROUP BY ALL)
WHERE {closed('minute', '1 MINUTE')}""")
def stream_rate_limit(spark, d):
    return _ntz(_closed(spark, WI.request_counts(event_stream(spark, d), "event_type", "ts", 1), "limit"), "minute")


@query("stream_job_progress", """SELECT user_id AS job_id, count(*) AS total_tasks, count(*) FILTER (event_type IN ('view', 'purchase')) AS completed_tasks,
  count(*) FILTER (event_type = 'error') AS failed_tasks FROM events GROUP BY 1""")
def stream_job_progress(spark, d):
    t = event_stream(spark, d).select(
        F.col("user_id").alias("job_id"),
        F.when(F.col("event_type").isin("view", "purchase"), "completed").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "processing").otherwise("pending").alias("status"),
        F.col("value").alias("duration_seconds"), F.col("ts").alias("completed_at"))
    out = fresh_path(spark, "progress")
    VT.merge_stream(WI.progress(t, V.as_of()), out, "job_id", fresh_path(spark, "ck")).awaitTermination()
    return VT.read_table(spark, out).select("job_id", "total_tasks", "completed_tasks", "failed_tasks")


@query("stream_message_flow", f"""WITH {V.MESSAGES_SQL} SELECT CASE WHEN queue <> 'error' THEN 'ok' WHEN retry_count >= max_retries THEN 'dead' ELSE 'retry' END AS outcome,
  CASE WHEN queue = 'error' AND retry_count < max_retries THEN retry_count + 1 ELSE retry_count END AS retry_count, count(*) AS n FROM messages GROUP BY ALL""")
def stream_message_flow(spark, d):
    m = event_stream(spark, d).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("queue"), (F.col("event_id") % 4).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"))
    out = fresh_path(spark, "flow")
    QU.run_flow(m, out, fresh_path(spark, "ck"), F.col("queue") == "error", "scraper", V.as_of()).awaitTermination()
    return QU.read_flow(spark, out).groupBy("outcome", "retry_count").agg(F.count("*").alias("n"))


@query("stream_first_in_ttl", "SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id")
def stream_first_in_ttl(spark, d):
    """With a time-to-live longer than the data only the first request of a key remains."""
    s = event_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = _closed(spark, QU.first_in_ttl(s, "user_id", "ts", "400 days"), "ttl")
    return _ntz(kept, "ts")


# the SQL of ttl_cache
@query("stream_first_in_short_ttl", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS key, epoch_us(ts) AS t FROM events),
run AS (
  SELECT key, min(t) AS t FROM e GROUP BY key
  UNION ALL
  SELECT r.key, (SELECT min(e.t) FROM e WHERE e.key = r.key AND e.t >= r.t + 86400000000) FROM run r WHERE r.t IS NOT NULL)
SELECT CAST(key AS VARCHAR) AS key, t FROM run WHERE t IS NOT NULL""")
def stream_first_in_short_ttl(spark, d):
    """A time-to-live shorter than the data: a key passes again and again."""
    s = event_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = _closed(spark, QU.first_in_ttl(s, "user_id", "ts", "1 day"), "ttl")
    return kept.select(F.col("user_id").cast("string").alias("key"), F.unix_micros("ts").alias("t"))


@query("stream_ema", f"""WITH {V.REQUESTS_SQL}, l AS (SELECT source, list(response_time ORDER BY ts, event_id) AS v FROM requests GROUP BY source)
SELECT source, len(v) AS requests, round(list_reduce(v, lambda a, x: a * 0.8 + x * 0.2), 6) AS ema FROM l""")
def stream_ema(spark, d):
    r = event_stream(spark, d).select(
        "event_id", "ts", F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("source"), F.col("value").alias("response_time"))
    out = fresh_path(spark, "ema")
    ST.ema_stream(r, ["ts", "event_id"], out, fresh_path(spark, "ck")).awaitTermination()
    return ST.latest_version(spark, out).withColumn("ema", F.round("ema", 6))


@query("stream_token_bucket", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS requests, count(*) AS allowed FROM events GROUP BY 1")
def stream_token_bucket(spark, d):
    """A rate no key exceeds: everything passes."""
    s = ST.token_bucket_stream(event_stream(spark, d), "user_id", "ts", rate=1000.0, burst=100)
    return _closed(spark, s, "bucket").groupBy("key").agg(F.sum("requests").alias("requests"), F.sum("allowed").alias("allowed"))


def held_sql(windows, condition, step, hold, keys="key", gaps=True, value="value"):
    """Runs of windows by their times; a run's first window tells since when."""
    gap = f"OR before + INTERVAL {step} <> window_start" if gaps else ""
    return f"""WITH w AS ({windows}), b AS (SELECT *, coalesce({condition}, false) AS met, lag(window_start) OVER (PARTITION BY {keys} ORDER BY window_start) AS before FROM w),
r AS (SELECT *, sum((coalesce(NOT met {gap}, false))::INT) OVER (PARTITION BY {keys} ORDER BY window_start) AS run FROM b),
s AS (SELECT *, min(CASE WHEN met THEN window_start END) OVER (PARTITION BY {keys}, run) AS since FROM r)
SELECT {keys}, window_start, round({value}, 6) AS value, met AND coalesce(window_start - INTERVAL {hold} >= since, false) AS alert FROM s"""


def sliding(hours, steps, what):
    return f"""SELECT * FROM (SELECT event_type AS key, time_bucket(INTERVAL '1 hour', ts) - to_hours(i) AS window_start, {what} AS value FROM events, range({steps}) r(i) GROUP BY ALL)
  WHERE {closed('window_start', f'{hours} HOUR')}"""


@query("stream_held_errors", held_sql(sliding(6, 6, "count(*) FILTER (event_id % 5 = 0) / count(*)"), "value > 0.1", "1 HOUR", "3 HOUR"))
def stream_held_errors(spark, d):
    s = AL.held_errors(event_stream(spark, d), "ts", F.col("event_id") % 5 == 0, window="6 hours", slide="1 hour", hold="3 hours", key=F.col("event_type"))
    return _ntz(_closed(spark, s, "held").withColumn("value", F.round("value", 6)), "window_start")


@query("held_errors", held_sql("""SELECT event_type AS key, time_bucket(INTERVAL '1 hour', ts) - to_hours(i) AS window_start, count(*) FILTER (event_id % 5 = 0) / count(*) AS value
  FROM events, range(6) r(i) GROUP BY ALL""", "value > 0.1", "1 HOUR", "3 HOUR"))
def held_errors(spark, d):
    """The same on the table."""
    w = MS.error_windows(table(spark, d, "events").withColumnRenamed("event_type", "key"), "ts", F.col("event_id") % 5 == 0, "6 hours", "1 hour", ["key"])
    held = MS.held_for(w, F.col("error_rate") > 0.1, "window_start", "1 hour", "3 hours", ["key"])
    return held.select("key", "window_start", F.round("error_rate", 6).alias("value"), "alert")


@query("stream_held_average", held_sql(sliding(6, 6, "avg(value)"), "value < 50", "1 HOUR", "2 HOUR"))
def stream_held_average(spark, d):
    s = AL.held_low_average(event_stream(spark, d), "ts", F.col("value"), 50, "6 hours", "1 hour", "2 hours", F.col("event_type"))
    return _ntz(_closed(spark, s, "held").withColumn("value", F.round("value", 6)), "window_start")


@query("stream_held_backlog", held_sql(f"""SELECT key, window_start, sum(change) OVER (PARTITION BY key ORDER BY window_start) AS value
  FROM (SELECT event_type AS key, date_trunc('hour', ts) AS window_start, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS change FROM events GROUP BY ALL)
  WHERE {closed('window_start', '1 HOUR')}""", "value > 10", "1 HOUR", "4 HOUR", gaps=False))
def stream_held_backlog(spark, d):
    delta = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    s = AL.held_backlog(event_stream(spark, d), "event_type", "ts", delta, 10, "1 hour", "4 hours")
    return _ntz(_closed(spark, s, "held").withColumn("value", F.round("value", 6)), "window_start")


@query("stream_consumer_lag", """WITH e AS (SELECT event_type AS queue, time_bucket(INTERVAL 1 DAY, ts) AS window_start, ts, event_id % 3 <> 0 AND ts + to_hours(event_id % 20) <= (SELECT max(ts) FROM events) AS acked FROM events)
SELECT queue, window_start, count(*) AS published, count(*) FILTER (acked) AS acked, count(*) FILTER (NOT acked) AS open FROM e GROUP BY ALL
HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 25 HOUR""")
def stream_consumer_lag(spark, d):
    """Two thirds of the messages are acknowledged, within twenty hours, if that comes before the last event."""
    e = event_stream(spark, d).select(F.col("event_type").alias("queue"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    last = table(spark, d, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    acked = e.withColumn("acked_at", F.expr("ts + make_dt_interval(0, cast(id % 20 as int))")).filter((F.col("id") % 3 != 0) & (F.col("acked_at") <= F.lit(last)))
    s = AL.consumer_lag_windows(e, acked, "1 day", "10 minutes")
    return _ntz(_closed(spark, s, "lag"), "window_start").filter(F.col("window_start") <= F.lit(last).cast("timestamp_ntz") - F.expr("interval 49 hours"))


@query("stream_stalled", """WITH e AS (SELECT user_id, ts, event_type = 'click' AS busy, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'click') AS next FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS started_us FROM e
WHERE busy AND CASE WHEN next IS NULL THEN ts + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE ELSE next - ts > INTERVAL 1 DAY END""")
def stream_stalled(spark, d):
    """A user's clicks with nothing after them for a day."""
    status = F.when(F.col("event_type") == "click", "processing").otherwise("completed")
    updates = event_stream(spark, d).select("user_id", "ts", status.alias("status"))
    return _closed(spark, ST.stalled_stream(updates, "user_id", "ts", 86_400_000), "stalled")

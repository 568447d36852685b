"""Metrics, source health, queue and limit queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.operators import limits as L
from crawlweave.operators import messages as MS
from crawlweave.operators import metrics as M
from crawlweave.operators import ordered as O
from crawlweave.operators import source_health as H
from crawlweave.operators.skew import join_lookup
from crawlweave.plans import views as V
from crawlweave.plans.registry import query, table
from crawlweave.session import fresh_path

NOW = f"TIMESTAMP '{V.AS_OF}'"
FAILED = F.col


def events(spark, d):
    return table(spark, d, "events")


@query("request_counters", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def request_counters(spark, d):
    return M.counters(events(spark, d), ["event_type", "user_id"])


LE = [*K.DURATION_BUCKETS, 25.0, 50.0, 100.0]


def histogram_sql(src, label, value, bounds):
    rows = ", ".join(f"({b})" for b in bounds) + ", ('infinity'::DOUBLE)"
    return (
        f"WITH le(le) AS (VALUES {rows}) SELECT {label}, CAST(le AS DOUBLE) AS le, count(*) FILTER ({value} <= le) AS cumulative, "
        f"count(*) AS count, round(sum({value}), 4) AS sum FROM {src}, le GROUP BY ALL"
    )


@query("histogram", histogram_sql("events", "event_type", "value", LE))
def histogram(spark, d):
    return M.histogram(events(spark, d), ["event_type"], "value", LE).withColumn("sum", F.round("sum", 4))


@query("score_histogram", histogram_sql("(SELECT role, (turn % 11) / 10.0 AS s FROM conversations)", "role", "s", K.SCORE_BUCKETS))
def score_histogram(spark, d):
    c = table(spark, d, "conversations").select("role", (F.col("turn") % 11 / 10).alias("s"))
    return M.histogram(c, ["role"], "s", K.SCORE_BUCKETS).withColumn("sum", F.round("sum", 4))


@query("percentiles", """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def percentiles(spark, d):
    p = M.percentiles(events(spark, d), ["event_type"], "value")
    return p.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query("percentiles_rollup", """SELECT event_type, count(*) AS n, TRUE AS p50_near, TRUE AS p95_near, TRUE AS p99_near FROM events
WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 13:00:00' GROUP BY event_type""")
def percentiles_rollup(spark, d):
    """Hourly sketches are stored and rolled up to a range; each percentile's place among the raw values is within the stated error."""
    path = fresh_path(spark, "sketches")
    e = events(spark, d)
    M.percentile_sketches(e, "ts", ["event_type"], "value").write.parquet(path)
    start, end = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20 13:00:00").cast("timestamp_ntz")
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = M.percentiles_of_sketches(spark.read.parquet(path), ["event_type"], list(points.values()), start, end)
    raw = e.filter(F.col("value").isNotNull() & (F.col("ts") >= start) & (F.col("ts") < end)).select("event_type", "value")
    places = join_lookup(raw, found, ["event_type"], "inner").groupBy("event_type", "n").agg(
        *[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"le_{p}") for p in points], *[F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"lt_{p}") for p in points]
    )
    near = lambda p, x: ((F.col(f"lt_{p}") <= x + M.RANK_ERROR) & (F.col(f"le_{p}") >= x - M.RANK_ERROR)).alias(f"{p}_near")
    return places.select("event_type", "n", *[near(p, x) for p, x in points.items()])


@query("success_rate", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok,
  round(count(*) FILTER (event_type <> 'error') / count(*) * 100, 6) AS success_pct, round(count(*) FILTER (event_type = 'error') / count(*) * 100, 6) AS error_pct
FROM events GROUP BY 1""")
def success_rate(spark, d):
    s = M.success_rate(events(spark, d), "ts", F.col("event_type") != "error")
    return s.withColumns({c: F.round(c, 6) for c in ("success_pct", "error_pct")})


@query("throughput", "SELECT date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def throughput(spark, d):
    return M.throughput(events(spark, d), "ts")


@query("score_average_alert", """WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, avg(value) AS a, count(value) AS n FROM events GROUP BY 1)
SELECT window_start, round(a, 6) AS avg_value, n, count(*) FILTER (a < 20) OVER (ORDER BY window_start ROWS 1 PRECEDING) = 2 AS alert FROM w""")
def score_average_alert(spark, d):
    a = M.average_by_window(events(spark, d), "ts", "value")
    return MS.held(a, F.col("avg_value") < 20, "window_start", 2).withColumn("avg_value", F.round("avg_value", 6))


STATS = """
stats AS (SELECT source, count(*) AS requests, count(*) FILTER (success) AS success_count, avg(response_time) AS avg_response_time FROM requests GROUP BY source)"""


@query("source_stats", f"""WITH {V.REQUESTS_SQL}, {STATS} SELECT source, requests, success_count, requests - success_count AS failure_count,
  round(success_count / requests, 6) AS success_rate, round(avg_response_time, 6) AS avg_response_time FROM stats""")
def source_stats(spark, d):
    s = H.source_stats(V.requests(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_response_time")})


@query("source_rank", f"""WITH {V.REQUESTS_SQL}, {STATS} SELECT source, round(0.7 * success_count / requests + 0.3 / (avg_response_time + 0.1), 6) AS score
FROM stats ORDER BY 0.7 * success_count / requests + 0.3 / (avg_response_time + 0.1) DESC, source LIMIT 3""")
def source_rank(spark, d):
    return H.source_rank(H.source_stats(V.requests(spark, d))).select("source", F.round("score", 6).alias("score"))


HEALTH_SRC = "r AS (SELECT user_id AS source, ts, event_id, event_type NOT IN ('error', 'click', 'view') AS success FROM events)"


@query("source_health", f"""WITH {HEALTH_SRC},
run AS (SELECT source, ts, event_id, success, count(*) OVER w AS n, count(*) FILTER (NOT success) OVER w AS f FROM r
  WINDOW w AS (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
flips AS (SELECT source, ts, event_id, CASE WHEN success THEN 'healthy' WHEN n >= 10 AND f / n > 0.5 THEN 'unhealthy' END AS st, n, f FROM run)
SELECT source, max(n) AS requests, max(f) AS failure_count, coalesce(arg_max(st, (ts, event_id)) FILTER (st IS NOT NULL), 'healthy') AS status FROM flips GROUP BY source""")
def source_health(spark, d):
    r = events(spark, d).select(F.col("user_id").alias("source"), "ts", "event_id", (~F.col("event_type").isin("error", "click", "view")).alias("success"))
    return H.source_health(r, ["ts", "event_id"])


@query("ema", f"""WITH {V.REQUESTS_SQL}, l AS (SELECT source, list(response_time ORDER BY ts, event_id) AS v FROM requests GROUP BY source)
SELECT source, len(v) AS requests, round(list_reduce(v, lambda a, x: a * 0.8 + x * 0.2), 6) AS ema FROM l""")
def ema(spark, d):
    return H.response_ema(V.requests(spark, d), ["ts", "event_id"]).withColumn("ema", F.round("ema", 6))


@query("retry_schedule", f"""WITH {V.MESSAGES_SQL}, a AS (SELECT id, ts, retry_count, unnest(range(retry_count + 1, max_retries + 1)) AS attempt FROM messages)
SELECT id, CAST(attempt AS INTEGER) AS attempt, CAST(least(2 ^ attempt, 60) AS DOUBLE) AS delay_seconds,
  ts + to_seconds(CAST(list_sum(list_transform(range(retry_count + 1, attempt + 1), lambda k: least(2 ^ k, 60))) AS BIGINT)) AS due_at FROM a""")
def retry_schedule(spark, d):
    return MS.retry_schedule(V.messages(spark, d))


@query("dlq_split", f"""WITH {V.MESSAGES_SQL} SELECT CASE WHEN queue <> 'error' THEN 'ok' WHEN retry_count >= max_retries THEN 'dead' ELSE 'retry' END AS outcome,
  retry_count, count(*) AS n FROM messages GROUP BY ALL""")
def dlq_split(spark, d):
    m = V.messages(spark, d)
    return m.groupBy(MS.outcome_label(F.col("queue") == "error").alias("outcome"), "retry_count").agg(F.count("*").alias("n"))


@query("dead_letters", f"""WITH {V.MESSAGES_SQL} SELECT id, queue, retry_count, 'scraper' AS service, {NOW} AS failed_at FROM messages WHERE queue = 'error' AND retry_count >= max_retries""")
def dead_letters(spark, d):
    dead = MS.split_outcomes(V.messages(spark, d), F.col("queue") == "error", "scraper", V.as_of())["dead"]
    return dead.select("id", "queue", "retry_count", "service", "failed_at")


@query("requeue", f"""WITH {V.MESSAGES_SQL} SELECT id, CASE WHEN queue = 'error' AND retry_count >= max_retries THEN 0 ELSE retry_count END AS retry_count FROM messages""")
def requeue(spark, d):
    m = V.messages(spark, d)
    parts = MS.split_outcomes(m, F.col("queue") == "error", "scraper", V.as_of())
    dead = parts["dead"].select(*m.columns)
    rest = m.join(dead.select("id"), "id", "left_anti").select(*m.columns)
    return MS.requeue(dead, rest).select("id", "retry_count")


@query("trim_queue", f"""WITH {V.MESSAGES_SQL} SELECT queue, id FROM (SELECT queue, id, row_number() OVER (PARTITION BY queue ORDER BY ts DESC, id DESC) AS r FROM messages) WHERE r <= 500""")
def trim_queue(spark, d):
    return MS.trim(V.messages(spark, d), 500).select("queue", "id")


@query("publish_order", f"""WITH {V.MESSAGES_SQL} SELECT queue, id, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, ts, id) AS position FROM messages""")
def publish_order(spark, d):
    return MS.publish_order(V.messages(spark, d)).select("queue", "id", "position")


@query("queue_stats", f"""WITH {V.MESSAGES_SQL} SELECT queue, count(*) AS published, count(*) FILTER (acked) AS processed, count(*) FILTER (NOT acked) AS length,
  count(*) FILTER (NOT acked) > 1000 AS backlog FROM messages GROUP BY queue""")
def queue_stats(spark, d):
    return MS.queue_stats(V.messages(spark, d), F.col("acked"))


@query("consumer_lag", """WITH p AS (SELECT event_type AS queue, max(event_id) AS last_published FROM events GROUP BY 1),
a AS (SELECT event_type AS queue, 'c' || CAST(user_id % 4 AS VARCHAR) AS consumer, max(event_id) AS last_acked, count(*) AS processed FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
SELECT queue, consumer, last_acked, processed, last_published, last_published - last_acked AS lag FROM a JOIN p USING (queue)""")
def consumer_lag(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("consumer"))
    return MS.consumer_lag(e, e.filter("seq % 3 <> 0"))


@query("backlog", f"""WITH w AS (SELECT event_type AS queue, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS change FROM events GROUP BY ALL),
b AS (SELECT *, CAST(sum(change) OVER (PARTITION BY queue ORDER BY window_start) AS BIGINT) AS length FROM w)
SELECT *, count(*) FILTER (length > 100) OVER (PARTITION BY queue ORDER BY window_start ROWS 1 PRECEDING) = 2 AS alert FROM b""")
def backlog(spark, d):
    e = events(spark, d).withColumnRenamed("event_type", "queue")
    series = MS.backlog_series(e, "ts", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))
    return MS.held(series, F.col("length") > 100, "window_start", 2, ["queue"])


def sliding_sql(every, wide, steps):
    return f"""SELECT time_bucket(INTERVAL {every}, ts) - to_seconds(CAST(i * {steps[0]} AS BIGINT)) AS window_start,
  count(*) AS total, count(*) FILTER (event_type = 'error') AS errors FROM events, range({steps[1]}) r(i) GROUP BY 1"""


@query("circuit_breaker", f"""WITH w AS ({sliding_sql('30 SECOND', '2 MINUTE', (30, 4))})
SELECT window_start, window_start + INTERVAL 2 MINUTE AS window_end, total, errors, round(errors / total, 6) AS error_rate, errors / total > 0.5 AS open FROM w""")
def circuit_breaker(spark, d):
    return MS.circuit_breaker(events(spark, d), "ts", F.col("event_type") == "error").withColumn("error_rate", F.round("error_rate", 6))


@query("error_alert", f"""WITH w AS ({sliding_sql('1 MINUTE', '5 MINUTE', (60, 5))})
SELECT window_start, total, errors, count(*) FILTER (errors / total > 0.1) OVER (ORDER BY window_start ROWS 1 PRECEDING) = 2 AS alert FROM w""")
def error_alert(spark, d):
    w = MS.error_windows(events(spark, d), "ts", F.col("event_type") == "error", "5 minutes", "1 minute")
    return MS.held(w, F.col("error_rate") > 0.1, "window_start", 2).select("window_start", "total", "errors", "alert")


@query("rate_limit_minute", """SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS requests, least(count(*), 1) AS allowed, count(*) - least(count(*), 1) AS rejected
FROM events GROUP BY ALL""")
def rate_limit_minute(spark, d):
    a = L.per_minute_audit(events(spark, d), "event_type", "ts", 1)
    return a.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("rate_limit_allowed", """SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 2""")
def rate_limit_allowed(spark, d):
    return L.per_minute_allowed(events(spark, d), "event_type", "ts", "event_id", 2).select("event_id", "rank")


@query("token_bucket", """WITH RECURSIVE e AS (SELECT event_type AS key, epoch_us(ts) AS t, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT key, t, n, row_number() OVER (PARTITION BY key ORDER BY t) AS i, t - lag(t, 1, t) OVER (PARTITION BY key ORDER BY t) AS gap FROM e),
run AS (
  SELECT key, t, n, i, least(n, 3) AS passed, 3000000000 - least(n, 3) * 1000000000 AS level FROM o WHERE i = 1
  UNION ALL
  SELECT o.key, o.t, o.n, o.i, least(o.n, least(3000000000, level + gap * 1) // 1000000000),
         least(3000000000, level + gap * 1) - least(o.n, least(3000000000, level + gap * 1) // 1000000000) * 1000000000
  FROM run JOIN o ON o.key = run.key AND o.i = run.i + 1)
SELECT key, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(passed) AS BIGINT) AS allowed, CAST(sum(n) - sum(passed) AS BIGINT) AS rejected FROM run GROUP BY key""")
def token_bucket(spark, d):
    """One request per 1000 seconds, bursts of three: sparse enough for the given event rate to exceed it."""
    return L.limit_totals(L.token_bucket_audit(events(spark, d), "event_type", "ts", rate=0.001, burst=3))


@query("ttl_cache", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS key, epoch_us(ts) AS t FROM events),
run AS (
  SELECT key, min(t) AS t FROM e GROUP BY key
  UNION ALL
  SELECT r.key, (SELECT min(e.t) FROM e WHERE e.key = r.key AND e.t >= r.t + 86400000000) FROM run r WHERE r.t IS NOT NULL)
SELECT CAST(key AS VARCHAR) AS key, t FROM run WHERE t IS NOT NULL""")
def ttl_cache(spark, d):
    return L.within_ttl(events(spark, d), "user_id", "ts", 86_400).filter("passed = 1").select("key", "t")


@query("running_requests", """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
  CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run,
  lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM events""")
def running_requests(spark, d):
    keys, order = ["event_type"], ["ts", "event_id"]
    c = O.chunked(events(spark, d), keys, order)
    a = O.running_sum(c, keys, order, F.lit(1), "rn")
    b = O.running_sum(a, keys, order, F.col("user_id"), "run")
    return O.previous_value(b, keys, order, "event_id", "previous").select("event_id", "event_type", "rn", "run", "previous")


@query("messages_by_action", f"""SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'rejected' END AS handler, count(*) AS n FROM events GROUP BY 1""")
def messages_by_action(spark, d):
    parts = MS.by_action(events(spark, d).withColumnRenamed("event_type", "action"), ("view", "click"))
    out = None
    for name, df in parts.items():
        part = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("handler"), "n")
        out = part if out is None else out.unionByName(part)
    return out

"""Job and task queries: progress, access, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.operators import access as A
from crawlweave.operators import maintain as M
from crawlweave.operators import messages as MS
from crawlweave.operators import task_jobs as T
from crawlweave.plans import views as V
from crawlweave.plans.registry import query, table
from crawlweave.session import fresh_path
from crawlweave.sources import versioned as VT

NOW = f"TIMESTAMP '{V.AS_OF}'"
PROGRESS = f"""
progress AS (SELECT job_id, count(*) AS total_tasks, count(*) FILTER (status = 'completed') AS completed_tasks,
  count(*) FILTER (status = 'failed') AS failed_tasks, count(*) FILTER (status = 'processing') AS in_progress_tasks,
  count(*) FILTER (status = 'pending') AS pending_tasks,
  coalesce(avg(duration_seconds) FILTER (status = 'completed' AND duration_seconds <> 0), 0) AS average_task_duration,
  count(*) FILTER (status = 'completed' AND completed_at > {NOW} - INTERVAL 300 MINUTE) / 300.0 AS current_throughput
  FROM tasks GROUP BY job_id)"""


def progress(spark, d):
    return T.job_progress(V.tasks(spark, d), V.as_of(), "INTERVAL 300 MINUTES")


@query("job_progress", f"""WITH {V.TASKS_SQL}, {PROGRESS}
SELECT job_id, total_tasks, completed_tasks, failed_tasks, in_progress_tasks, pending_tasks, round(average_task_duration, 6) AS average_task_duration,
  round(current_throughput, 6) AS current_throughput, round(completed_tasks / total_tasks * 100, 6) AS progress_percentage,
  CASE WHEN current_throughput > 0 AND pending_tasks + in_progress_tasks > 0
    THEN {NOW} + to_microseconds(CAST(round((pending_tasks + in_progress_tasks) / current_throughput * 60 * 1000000) AS BIGINT)) END AS estimated_completion
FROM progress""")
def job_progress(spark, d):
    p = progress(spark, d)
    return p.withColumns({c: F.round(c, 6) for c in ("average_task_duration", "current_throughput", "progress_percentage")})


@query("job_status", f"""WITH {V.TASKS_SQL}, {PROGRESS}
SELECT job_id, CASE WHEN pending_tasks = 0 AND in_progress_tasks = 0 THEN CASE WHEN completed_tasks > 0 THEN 'completed' ELSE 'failed' END
  WHEN in_progress_tasks > 0 OR completed_tasks > 0 THEN 'processing' ELSE 'pending' END AS job_status FROM progress""")
def job_status(spark, d):
    return T.job_status(progress(spark, d)).select("job_id", "job_status")


@query("job_status_orders", f"""WITH {V.JOB_TASKS_SQL},
p AS (SELECT job_id, count(*) FILTER (status = 'pending') AS w, count(*) FILTER (status = 'completed') AS c FROM job_tasks GROUP BY job_id)
SELECT job_id, CASE WHEN w = 0 THEN CASE WHEN c > 0 THEN 'completed' ELSE 'failed' END WHEN c > 0 THEN 'processing' ELSE 'pending' END AS job_status FROM p""")
def job_status_orders(spark, d):
    return T.job_status(T.job_progress(V.job_tasks(spark, d), V.as_of())).select("job_id", "job_status")


@query("job_stats", f"""WITH {V.TASKS_SQL}, s AS (SELECT job_id, count(*) AS total_urls, count(*) FILTER (status = 'completed') AS completed_urls,
  count(*) FILTER (status = 'failed') AS failed_urls, count(*) FILTER (status = 'pending') AS pending_urls, count(*) FILTER (status = 'processing') AS processing_urls,
  avg(duration_seconds) FILTER (status = 'completed') AS avg_time FROM tasks GROUP BY job_id)
SELECT job_id, total_urls, completed_urls, failed_urls, pending_urls, processing_urls, round(avg_time, 6) AS average_processing_time,
  round(completed_urls / total_urls * 100, 6) AS progress_percentage,
  CASE WHEN avg_time > 0 AND pending_urls > 0 THEN date_trunc('second', {NOW} + to_microseconds(CAST(round(avg_time * pending_urls * 1000000) AS BIGINT))) END AS estimated_completion FROM s""")
def job_stats(spark, d):
    s = T.job_stats(V.tasks(spark, d), V.as_of())
    return s.withColumns({c: F.round(c, 6) for c in ("average_processing_time", "progress_percentage")}).withColumn(
        "estimated_completion", F.date_trunc("second", "estimated_completion").cast("timestamp_ntz"))


@query("progress_lines", f"""WITH {V.TASKS_SQL} SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'completed') / count(*) * 100, 2) AS progress_percentage FROM tasks GROUP BY job_id""")
def progress_lines(spark, d):
    return T.progress_lines(progress(spark, d))


@query("job_flags", f"""WITH {V.JOBS_SQL}, {V.JOB_TASKS_SQL}, c AS (SELECT job_id, count(*) AS n, count(*) FILTER (status = 'completed') AS k FROM job_tasks GROUP BY job_id)
SELECT j.job_id, round(CASE WHEN coalesce(n, 0) > 0 THEN k / n * 100 ELSE 0 END, 6) AS progress_percentage, status = 'completed' AS is_complete
FROM jobs j LEFT JOIN c ON j.job_id = c.job_id""")
def job_flags(spark, d):
    c = V.job_tasks(spark, d).groupBy("job_id").agg(
        F.count("*").alias("total_urls"), F.count_if(F.col("status") == "completed").alias("completed_urls"))
    j = V.jobs(spark, d).join(c, "job_id", "left")
    j = j.fillna(0, ["total_urls", "completed_urls"])
    return T.with_job_flags(j).select("job_id", F.round("progress_percentage", 6).alias("progress_percentage"), "is_complete")


@query("system_stats", f"""WITH {V.JOBS_SQL}, {V.TASKS_SQL}
SELECT 'job' AS entity, status, count(*) AS n FROM jobs GROUP BY status UNION ALL SELECT 'task', status, count(*) FROM tasks GROUP BY status""")
def system_stats(spark, d):
    return T.system_stats(V.jobs(spark, d), V.tasks(spark, d))


@query("high_failure", f"""WITH {V.TASKS_SQL} SELECT job_id, count(*) AS total_tasks, count(*) FILTER (status = 'failed') AS failed_tasks,
  round(count(*) FILTER (status = 'failed') / count(*), 6) AS failure_rate, 'failed' AS new_status FROM tasks GROUP BY job_id
HAVING count(*) FILTER (status = 'failed') / count(*) > 0.2 AND count(*) > 10""")
def high_failure(spark, d):
    return T.high_failure_jobs(V.tasks(spark, d), rate=0.2).withColumn("failure_rate", F.round("failure_rate", 6))


@query("worker_distribution", f"""WITH {V.JOB_TASKS_SQL}, {V.JOB_RESULTS_SQL}
SELECT t.job_id, worker_type, count(*) AS n_tasks, round(avg(content_quality_score), 6) AS avg_score,
  count(*) FILTER (content_quality_score >= 0.77) AS high_quality, count(*) FILTER (content_quality_score >= 0.5 AND content_quality_score < 0.77) AS medium_quality,
  count(*) FILTER (content_quality_score < 0.5) AS low_quality
FROM job_tasks t LEFT JOIN job_results r ON t.task_id = r.task_id GROUP BY ALL""")
def worker_distribution(spark, d):
    return T.worker_distribution(V.job_tasks(spark, d), V.job_results(spark, d)).withColumn("avg_score", F.round("avg_score", 6))


@query("list_jobs", f"""WITH {V.JOBS_SQL}, f AS (SELECT * FROM jobs WHERE status = 'pending' AND name ILIKE '%high%' AND created_at >= TIMESTAMP '1995-01-01')
SELECT job_id, name, created_at, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 3 * 20 AS has_next, TRUE AS has_previous
FROM f ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40""")
def list_jobs(spark, d):
    after = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    out = A.list_jobs(V.jobs(spark, d), page=3, status="pending", search="high", created_after=after)
    return out.select("job_id", "name", "created_at", "total", "has_next", "has_previous")


@query("list_jobs_after", f"""WITH {V.JOBS_SQL} SELECT job_id, created_at FROM jobs WHERE created_at < TIMESTAMP '1997-01-01'
  OR (created_at = TIMESTAMP '1997-01-01' AND job_id > 5000) ORDER BY created_at DESC, job_id LIMIT 20""")
def list_jobs_after(spark, d):
    return A.list_jobs_after(V.jobs(spark, d), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), F.lit(5000)).select("job_id", "created_at")


@query("list_tasks", f"""WITH {V.TASKS_SQL}, f AS (SELECT * FROM tasks WHERE job_id = 7 AND status = 'completed')
SELECT task_id, created_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, task_id LIMIT 10""")
def list_tasks(spark, d):
    return A.list_tasks(V.tasks(spark, d), 7, "completed", page_size=10).select("task_id", "created_at", "total")


@query("task_by_id", f"WITH {V.TASKS_SQL} SELECT task_id, job_id, status FROM tasks WHERE task_id = 42")
def task_by_id(spark, d):
    return A.by_id(V.tasks(spark, d), "task_id", 42).select("task_id", "job_id", "status")


@query("job_task_join", f"""WITH {V.JOBS_SQL}, {V.JOB_TASKS_SQL} SELECT j.job_id, j.status, t.task_id, t.status AS task_status
FROM jobs j LEFT JOIN job_tasks t ON j.job_id = t.job_id""")
def job_task_join(spark, d):
    return A.jobs_with_tasks(V.jobs(spark, d), V.job_tasks(spark, d).withColumnRenamed("status", "task_status").select("task_id", "job_id", "task_status")).select(
        "job_id", "status", F.col("task_id"), F.col("task_status"))


@query("task_result_join", f"""WITH {V.TASKS_SQL}, {V.RESULTS_SQL} SELECT t.task_id, t.status, r.content_quality_score FROM tasks t LEFT JOIN results r ON t.task_id = r.task_id""")
def task_result_join(spark, d):
    return A.tasks_with_results(V.tasks(spark, d), V.results(spark, d)).select("task_id", "status", "content_quality_score")


@query("job_report", f"""WITH {V.JOBS_SQL}, {V.JOB_TASKS_SQL}, {V.JOB_RESULTS_SQL}
SELECT j.job_id, j.status, count(t.task_id) AS n_tasks, coalesce(count(r.task_id), 0) AS n_results, round(avg(content_quality_score), 6) AS avg_score
FROM jobs j LEFT JOIN job_tasks t ON j.job_id = t.job_id LEFT JOIN job_results r ON t.task_id = r.task_id GROUP BY j.job_id, j.status""")
def job_report(spark, d):
    r = A.job_report(V.jobs(spark, d), V.job_tasks(spark, d), V.job_results(spark, d))
    return r.select("job_id", "status", "n_tasks", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.round("avg_score", 6).alias("avg_score"))


@query("can_retry", f"WITH {V.TASKS_SQL} SELECT task_id FROM tasks WHERE status = 'failed' AND retry_count < max_retries")
def can_retry(spark, d):
    return M.can_retry(V.tasks(spark, d)).select("task_id")


@query("tasks_without_result", f"WITH {V.TASKS_SQL}, {V.RESULTS_SQL} SELECT status, count(*) AS n FROM tasks WHERE task_id NOT IN (SELECT task_id FROM results) GROUP BY status")
def tasks_without_result(spark, d):
    return M.without_result(V.tasks(spark, d), V.results(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def retry_ids(spark, d):
    """Every seventh event id, and as many ids that do not exist."""
    ids = table(spark, d, "events").filter("event_id % 7 = 0").select(F.col("event_id").alias("task_id"))
    return ids.unionByName(ids.select((-F.col("task_id") - 1).alias("task_id")))


RETRY_IDS = "ids AS (SELECT event_id AS task_id FROM events WHERE event_id % 7 = 0 UNION ALL SELECT -event_id - 1 FROM events WHERE event_id % 7 = 0)"


@query("retry_outcomes", f"""WITH {V.TASKS_SQL}, {RETRY_IDS} SELECT i.task_id, coalesce(status = 'failed', FALSE) AS ok,
  CASE WHEN status IS NULL THEN 'Task ' || CAST(i.task_id AS VARCHAR) || ' not found' WHEN status <> 'failed' THEN 'Task ' || CAST(i.task_id AS VARCHAR) || ' is not in failed status' END AS message
FROM ids i LEFT JOIN tasks t ON i.task_id = t.task_id""")
def retry_outcomes(spark, d):
    return M.retry_outcomes(retry_ids(spark, d), V.tasks(spark, d))


@query("bulk_outcome", f"""WITH {V.TASKS_SQL}, {RETRY_IDS} SELECT count(*) FILTER (status = 'failed') AS success_count, count(*) - count(*) FILTER (status = 'failed') AS failure_count
FROM ids i LEFT JOIN tasks t ON i.task_id = t.task_id""")
def bulk_outcome(spark, d):
    return T.bulk_outcome(M.retry_outcomes(retry_ids(spark, d), V.tasks(spark, d)))


@query("retry_tasks", f"""WITH {V.TASKS_SQL} SELECT task_id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN NOT hit THEN error_message END AS error_message, CASE WHEN NOT hit THEN started_at END AS started_at, CASE WHEN NOT hit THEN completed_at END AS completed_at
FROM (SELECT *, status = 'failed' AND task_id % 7 = 0 AS hit FROM tasks)""")
def retry_tasks(spark, d):
    out = M.retry_tasks(V.tasks(spark, d), retry_ids(spark, d), reset_count=True)
    return out.select("task_id", "status", "retry_count", "error_message", "started_at", "completed_at")


def cancel_ids(spark, d):
    return table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("job_id"))


@query("cancel_job", f"""WITH {V.JOBS_SQL} SELECT job_id, CASE WHEN hit THEN 'cancelled' ELSE status END AS status, CASE WHEN hit THEN {NOW} ELSE completed_at END AS completed_at
FROM (SELECT *, job_id % 5 = 0 AND status <> 'completed' AS hit FROM jobs)""")
def cancel_job(spark, d):
    jobs, _ = M.cancel_jobs(V.jobs(spark, d), V.job_tasks(spark, d), cancel_ids(spark, d), V.as_of())
    return jobs.select("job_id", "status", "completed_at")


@query("cancel_job_tasks", f"""WITH {V.JOBS_SQL}, {V.JOB_TASKS_SQL}
SELECT task_id, CASE WHEN hit THEN 'failed' ELSE t.status END AS status, CASE WHEN hit THEN 'Cancelled by user' END AS error_message, CASE WHEN hit THEN {NOW} ELSE t.completed_at END AS completed_at
FROM (SELECT t.*, coalesce(j.job_id % 5 = 0 AND j.status <> 'completed', FALSE) AND t.status IN ('pending', 'processing') AS hit
  FROM job_tasks t LEFT JOIN jobs j ON t.job_id = j.job_id) t""")
def cancel_job_tasks(spark, d):
    _, tasks = M.cancel_jobs(V.jobs(spark, d), V.job_tasks(spark, d), cancel_ids(spark, d), V.as_of())
    return tasks.select("task_id", "status", "error_message", "completed_at")


@query("cancel_outcomes", f"""WITH {V.JOBS_SQL} SELECT job_id, status <> 'completed' AS ok, CASE WHEN status = 'completed' THEN 'Job is already finished' END AS message
FROM jobs WHERE job_id % 5 = 0""")
def cancel_outcomes(spark, d):
    return M.cancel_outcomes(V.jobs(spark, d), cancel_ids(spark, d))


@query("pause_resume", f"""WITH {V.JOBS_SQL} SELECT job_id, CASE WHEN job_id % 3 = 0 AND status = 'processing' THEN 'paused' ELSE status END AS status,
  job_id % 3 = 0 AND status = 'processing' AS applied FROM jobs""")
def pause_resume(spark, d):
    jobs = V.jobs(spark, d)
    m = F.col("job_id") % 3
    commands = jobs.filter(m < 2).select("job_id", F.when(m == 0, "pause").otherwise("resume").alias("action"))
    return M.pause_resume(jobs, commands).select("job_id", "status", "applied")


@query("rename_jobs", f"""WITH {V.JOBS_SQL} SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 'renamed ' || CAST(job_id AS VARCHAR) ELSE name END AS name,
  CASE WHEN job_id % 4 = 1 THEN 'about' END AS description FROM jobs""")
def rename_jobs(spark, d):
    jobs = V.jobs(spark, d)
    m = F.col("job_id") % 4
    updates = jobs.filter(m < 2).select(
        "job_id", F.when(m == 0, F.concat(F.lit("renamed "), F.col("job_id").cast("string"))).alias("name"),
        F.when(m == 1, F.lit("about")).alias("description"))
    return M.rename_jobs(jobs, updates).select("job_id", "name", "description")


@query("cascade_delete", f"""WITH {V.JOBS_SQL}, {V.JOB_TASKS_SQL}, {V.JOB_RESULTS_SQL},
t AS (SELECT * FROM job_tasks WHERE NOT (job_id % 5 = 0 AND job_id IN (SELECT job_id FROM jobs)))
SELECT 'jobs' AS entity, count(*) AS n FROM jobs WHERE job_id % 5 <> 0 UNION ALL SELECT 'tasks', count(*) FROM t
UNION ALL SELECT 'results', count(*) FROM job_results WHERE task_id IN (SELECT task_id FROM t)""")
def cascade_delete(spark, d):
    kept = M.delete_jobs(V.jobs(spark, d), V.job_tasks(spark, d), V.job_results(spark, d), cancel_ids(spark, d))
    out = None
    for name, df in zip(("jobs", "tasks", "results"), kept):
        part = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("stalled", f"""WITH {V.TASKS_SQL} SELECT task_id, CASE WHEN hit AND retry_count + 1 >= max_retries THEN 'failed' WHEN hit THEN 'pending' ELSE status END AS status,
  CASE WHEN NOT hit THEN started_at END AS started_at, CASE WHEN hit THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN hit AND retry_count + 1 >= max_retries THEN 'Task stalled - exceeded maximum retries' ELSE error_message END AS error_message, hit AS stalled
FROM (SELECT *, status = 'processing' AND started_at < {NOW} - INTERVAL 1 HOUR AS hit FROM tasks)""")
def stalled(spark, d):
    return M.reset_stalled(V.tasks(spark, d), V.as_of()).select("task_id", "status", "started_at", "retry_count", "error_message", "stalled")


@query("retention", f"""WITH {V.JOBS_SQL}, {V.JOB_TASKS_SQL}, {V.JOB_RESULTS_SQL},
old AS (SELECT job_id FROM jobs WHERE status = 'completed' AND completed_at < TIMESTAMP '1996-01-01' - INTERVAL 7 DAY),
t AS (SELECT * FROM job_tasks WHERE job_id NOT IN (SELECT job_id FROM old))
SELECT 'archived' AS entity, count(*) AS n FROM old UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE job_id NOT IN (SELECT job_id FROM old)
UNION ALL SELECT 'tasks', count(*) FROM t UNION ALL SELECT 'results', count(*) FROM job_results WHERE task_id IN (SELECT task_id FROM t)""")
def retention(spark, d):
    parts = M.apply_retention(V.jobs(spark, d), V.job_tasks(spark, d), V.job_results(spark, d), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    out = None
    for name, df in parts.items():
        part = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("latest_status", """SELECT user_id, event_type AS last_type, value AS last_value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_status(spark, d):
    e = table(spark, d, "events")
    out = M.latest_status(e, "user_id", ["ts", "event_id"], ["event_type", "value"])
    return out.select("user_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))


MERGE_SQL = """WITH ch AS (SELECT event_id % 20000 AS id, event_id, event_type, value FROM events WHERE event_id % 3 = 0),
newest AS (SELECT id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS v FROM ch GROUP BY id),
base AS (SELECT o_orderkey AS id, o_orderpriority AS name FROM orders)
SELECT b.id, name FROM base b WHERE id NOT IN (SELECT id FROM newest) UNION ALL SELECT id, 'set ' || kind FROM newest WHERE kind <> 'error'"""


@query("merge_rows", MERGE_SQL)
def merge_rows(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    changes = table(spark, d, "events").filter("event_id % 3 = 0").select(
        (F.col("event_id") % 20000).alias("id"), F.concat(F.lit("set "), "event_type").alias("name"),
        (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("version"))
    return M.merge_rows(base, changes, "id", "version")


@query("merge_bucketed", """WITH ch AS (SELECT event_id % 20000 AS id, event_id, event_type FROM events),
newest AS (SELECT id, arg_max(event_type, event_id) AS kind FROM ch GROUP BY id)
SELECT o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_orderkey NOT IN (SELECT id FROM newest) UNION ALL SELECT id, 'set ' || kind FROM newest WHERE kind <> 'error'""")
def merge_bucketed(spark, d):
    """Three batches of changes to a bucketed table, the second merged twice; then its newest version."""
    path = fresh_path(spark, "bucketed")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    VT.create_table(orders, path, "id", 16)
    changes = table(spark, d, "events").select(
        (F.col("event_id") % 20000).alias("id"), F.concat(F.lit("set "), "event_type").alias("name"), (F.col("event_type") == "error").alias("deleted"),
        F.col("event_id").alias("version"), F.col("event_id").alias("_at"))
    top = changes.agg(F.max("_at")).first()[0] or 0
    for batch, (low, high) in enumerate(((-1, top // 3), (top // 3, top // 2), (top // 3, top // 2), (top // 2, top)), 1):
        VT.merge_bucketed(changes.filter((F.col("_at") > low) & (F.col("_at") <= high)).drop("_at"), path, "id", "version", max(1, batch - (batch > 2)))
    return VT.read_table(spark, path)


@query("apply_commands", f"""WITH {V.JOBS_SQL} SELECT action, ok, count(*) AS n FROM (
  SELECT CASE job_id % 6 WHEN 0 THEN 'cancel' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume' WHEN 3 THEN 'rename' ELSE 'delete' END AS action,
    CASE job_id % 6 WHEN 0 THEN status <> 'completed' WHEN 1 THEN status = 'processing' WHEN 2 THEN FALSE ELSE TRUE END AS ok
  FROM jobs WHERE job_id % 6 < 5) GROUP BY ALL""")
def apply_commands(spark, d):
    jobs = V.jobs(spark, d)
    return M.apply_commands(jobs, V.job_tasks(spark, d), V.job_results(spark, d), command_rows(jobs), V.as_of())["outcomes"].groupBy(
        "action", "ok").agg(F.count("*").alias("n"))


def command_rows(jobs):
    m = F.col("job_id") % 6
    action = F.when(m == 0, "cancel").when(m == 1, "pause").when(m == 2, "resume").when(m == 3, "rename").otherwise("delete")
    return jobs.filter(m < 5).select("job_id", action.alias("action"), F.when(m == 3, "new name").alias("name"), F.lit(None).cast("string").alias("description"))


@query("apply_commands_jobs", f"""WITH {V.JOBS_SQL} SELECT job_id, CASE WHEN job_id % 6 = 3 THEN 'new name' ELSE name END AS name,
  CASE WHEN job_id % 6 = 0 AND status <> 'completed' THEN 'cancelled' WHEN job_id % 6 = 1 AND status = 'processing' THEN 'paused' ELSE status END AS status
FROM jobs WHERE job_id % 6 <> 4""")
def apply_commands_jobs(spark, d):
    jobs = V.jobs(spark, d)
    out = M.apply_commands(jobs, V.job_tasks(spark, d), V.job_results(spark, d), command_rows(jobs), V.as_of())
    return out["jobs"].select("job_id", "name", "status")


@query("failed_jobs_of_dead_messages", f"""WITH {V.MESSAGES_SQL}, j AS (SELECT DISTINCT user_id AS job_id FROM events)
SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM messages WHERE queue = 'error' AND retry_count >= max_retries) THEN 'failed' ELSE 'processing' END AS status FROM j""")
def failed_jobs_of_dead_messages(spark, d):
    m = V.messages(spark, d)
    dead = MS.split_outcomes(m, F.col("queue") == "error", "ingestion", V.as_of())["dead"]
    jobs = m.select("job_id").distinct().select("job_id", F.lit("processing").alias("status"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return MS.fail_jobs_of(dead, jobs, V.as_of()).select("job_id", "status")

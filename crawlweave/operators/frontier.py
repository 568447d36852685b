"""From URLs to tasks: routing, priority, batching, queue messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import routing as R
from crawlweave.functions import urls as U
from crawlweave.operators import ordered
from crawlweave.operators.url_jobs import robots_filter

BATCH = 100


def task_id(job: Column, norm_url: Column) -> Column:
    """Same job and URL always give the same id, so a rerun adds nothing twice."""
    return F.md5(F.concat(job.cast("string"), F.lit("|"), norm_url))


def build_tasks(
    urls: DataFrame, order: list[str], config: Column | None = None, batch: int = BATCH, smart: bool = False
) -> DataFrame:
    """Pending tasks from (job_id, url, order...) rows, numbered in batches per job.

    ``order`` must be unique inside a job. The numbering is exact and does not send a
    whole job to one task.
    """
    cfg = config if config is not None else R.empty_config()
    route = R.route_smart if smart else R.route_ingest
    numbered = ordered.number_rows(urls, ["job_id"], order, "_rn")
    return numbered.withColumn("_cfg", cfg).select(
        task_id(F.col("job_id"), F.col("url")).alias("task_id"),
        "job_id",
        "url",
        F.lit("pending").alias("status"),
        route(F.col("url"), F.col("_cfg")).alias("worker_type"),
        R.priority(F.col("url"), F.col("_cfg")).alias("priority"),
        F.lit(0).alias("retry_count"),
        F.coalesce(F.col("_cfg.retries"), F.lit(3)).alias("max_retries"),
        R.task_config(F.col("_cfg")).alias("config"),
        F.floor((F.col("_rn") - 1) / batch).cast("long").alias("batch_no"),
    )


def new_urls(urls: DataFrame, known_tasks: DataFrame) -> DataFrame:
    """URLs of a job that have no task yet."""
    known = known_tasks.select("job_id", U.normalize_url(F.col("url")).alias("url")).distinct()
    return urls.join(known, ["job_id", "url"], "left_anti")


def frontier(urls: DataFrame, known_tasks: DataFrame, rules: DataFrame, order: list[str], **kw) -> DataFrame:
    """New, allowed, routed, prioritised, batched tasks."""
    allowed = robots_filter(new_urls(urls, known_tasks), rules).filter("allowed").drop("allowed", "host")
    return build_tasks(allowed, order, **kw)


def task_messages(tasks: DataFrame) -> DataFrame:
    """Queue name, priority and JSON body per task."""
    body = F.to_json(F.struct("task_id", "job_id", "url", "worker_type", "priority", "config"))
    return tasks.select(
        F.col("task_id").alias("id"),
        R.queue_name(F.col("worker_type")).alias("queue"),
        "priority",
        body.alias("data"),
        F.lit(0).alias("retry_count"),
        "max_retries",
    )


def balance_pending(tasks: DataFrame, config: Column | None = None) -> DataFrame:
    """Pending tasks with the worker kind the smart router prefers, and its queue."""
    cfg = config if config is not None else R.empty_config()
    return (
        tasks.filter("status = 'pending'")
        .withColumn("_cfg", cfg)
        .withColumn("worker_type", R.route_smart(F.col("url"), F.col("_cfg")))
        .withColumn("queue", R.queue_name(F.col("worker_type")))
        .drop("_cfg")
    )


def ingest_rollup(jobs: DataFrame, report: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per job: URLs read, tasks made, resulting status (failed when nothing was usable)."""
    made = tasks.groupBy("job_id").agg(F.count("*").alias("tasks_created"))
    return (
        jobs.join(report.select("job_id", F.col("valid").alias("total_urls")), "job_id", "left")
        .join(made, "job_id", "left")
        .withColumn("total_urls", F.coalesce("total_urls", F.lit(0)))
        .withColumn("tasks_created", F.coalesce("tasks_created", F.lit(0)))
        .withColumn("status", F.when(F.col("tasks_created") > 0, "processing").otherwise("failed"))
    )


def check_configs(df: DataFrame, config: str = "config") -> DataFrame:
    """Adds ``valid`` and ``reason``."""
    reason = R.config_problem(F.col(config))
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())

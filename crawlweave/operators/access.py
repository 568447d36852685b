"""Filtered, ordered, paged reads and the standard joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K


def filter_jobs(
    jobs: DataFrame, status: str | None = None, search: str | None = None,
    created_after: Column | None = None, created_before: Column | None = None,
) -> DataFrame:
    out = jobs
    if status is not None:
        out = out.filter(F.col("status") == status)
    if search:
        out = out.filter(F.col("name").ilike(f"%{search}%"))
    if created_after is not None:
        out = out.filter(F.col("created_at") >= created_after)
    if created_before is not None:
        out = out.filter(F.col("created_at") <= created_before)
    return out


def _page(df: DataFrame, key: str, page: int, page_size: int) -> DataFrame:
    """One page, newest first, with the paging facts on each row; the total is a scalar subquery."""
    total = df.groupBy().agg(F.count("*")).scalar()
    rows = df.orderBy(F.desc("created_at"), key).offset((page - 1) * page_size).limit(page_size)
    return (
        rows.withColumn("total", total)
        .withColumn("has_next", F.col("total") > page * page_size)
        .withColumn("has_previous", F.lit(page > 1))
    )


def list_jobs(jobs: DataFrame, page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    return _page(filter_jobs(jobs, **filters), "job_id", page, page_size)


def list_jobs_after(jobs: DataFrame, last_created: Column, last_id: Column, page_size: int = 20, **filters) -> DataFrame:
    """Next page by key instead of by offset; its cost does not grow with the page number."""
    beyond = (F.col("created_at") < last_created) | (
        (F.col("created_at") == last_created) & (F.col("job_id") > last_id)
    )
    return filter_jobs(jobs, **filters).filter(beyond).orderBy(F.desc("created_at"), "job_id").limit(page_size)


def list_tasks(tasks: DataFrame, job_id, status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """Tasks of a job; an unknown status is ignored."""
    out = tasks.filter(F.col("job_id") == job_id)
    if status in K.TASK_STATUSES:
        out = out.filter(F.col("status") == status)
    return _page(out, "task_id", page, page_size)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def jobs_with_tasks(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Left join, written as inner join plus the jobs without tasks.

    In an inner join AQE may split a job with very many tasks; in a left join it may not. Jobs are
    hashed and tasks stream past them, so no task of the job sorts or holds its part of all tasks.
    """
    t = tasks.select(*[F.col(c).alias(c if c == "job_id" else f"task_{c.removeprefix('task_')}") for c in tasks.columns])
    idle = jobs.join(tasks.select("job_id").distinct().hint("shuffle_hash"), "job_id", "left_anti")
    return jobs.hint("shuffle_hash").join(t, "job_id").unionByName(idle, allowMissingColumns=True)


def tasks_with_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    clash = [c for c in results.columns if c in tasks.columns and c != "task_id"]
    return tasks.join(results.drop(*clash), "task_id", "left")


def job_report(jobs: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Per job: tasks, results, mean score. Results are joined per task, then reduced before the job join."""
    per_job = (
        tasks.select("task_id", "job_id")
        .join(results.select("task_id", "content_quality_score"), "task_id", "left")
        .groupBy("job_id")
        .agg(
            F.count("*").alias("n_tasks"),
            F.count("content_quality_score").alias("n_results"),
            F.avg("content_quality_score").alias("avg_score"),
        )
    )
    return jobs.join(per_job, "job_id", "left").withColumn("n_tasks", F.coalesce("n_tasks", F.lit(0)))

"""Task and job aggregates: progress, statistics, alerts on failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions import scores as S


def _is(status: str) -> Column:
    return F.col("status") == status


def _minutes_after(as_of: Column, minutes: Column) -> Column:
    """as_of plus fractional minutes, whole microseconds, same timestamp type as ``as_of``."""
    return as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (minutes * 60).cast("decimal(18,6)"))


def job_progress(tasks: DataFrame, as_of: Column, window: str = "INTERVAL 10 MINUTES") -> DataFrame:
    """Counts, percentage, mean duration, completions per minute and expected end per job.

    One aggregation with map-side partial sums: a job with most of the tasks is as cheap
    as any other.
    """
    minutes = F.expr(f"(unix_timestamp(timestamp'2020-01-01' + {window}) - unix_timestamp(timestamp'2020-01-01')) / 60")
    done = _is("completed")
    recent = done & (F.col("completed_at") > as_of - F.expr(window))
    agg = tasks.groupBy("job_id").agg(
        F.count("*").alias("total_tasks"),
        F.count_if(done).alias("completed_tasks"),
        F.count_if(_is("failed")).alias("failed_tasks"),
        F.count_if(_is("processing")).alias("in_progress_tasks"),
        F.count_if(_is("pending")).alias("pending_tasks"),
        F.coalesce(F.avg(F.when(done & (F.col("duration_seconds") != 0), F.col("duration_seconds"))), F.lit(0.0))
        .alias("average_task_duration"),
        (F.count_if(recent) / minutes).alias("current_throughput"),
    )
    left = F.col("pending_tasks") + F.col("in_progress_tasks")
    eta = F.when(
        (F.col("current_throughput") > 0) & (left > 0),
        _minutes_after(as_of, F.try_divide(left, F.col("current_throughput"))),
    )
    return agg.withColumn(
        "progress_percentage", F.col("completed_tasks") / F.col("total_tasks") * 100
    ).withColumn("estimated_completion", eta)


def job_status(progress: DataFrame) -> DataFrame:
    """Adds the status that follows from the counts."""
    idle = (F.col("pending_tasks") == 0) & (F.col("in_progress_tasks") == 0)
    started = (F.col("in_progress_tasks") > 0) | (F.col("completed_tasks") > 0)
    return progress.withColumn(
        "job_status",
        F.when(idle & (F.col("completed_tasks") > 0), "completed")
        .when(idle, "failed")
        .when(started, "processing")
        .otherwise("pending"),
    )


def job_stats(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Counts per job, mean processing time, expected end = mean x pending."""
    agg = tasks.groupBy("job_id").agg(
        F.count("*").alias("total_urls"),
        F.count_if(_is("completed")).alias("completed_urls"),
        F.count_if(_is("failed")).alias("failed_urls"),
        F.count_if(_is("pending")).alias("pending_urls"),
        F.count_if(_is("processing")).alias("processing_urls"),
        F.avg(F.when(_is("completed"), F.col("duration_seconds"))).alias("average_processing_time"),
    )
    eta = F.when(
        (F.col("average_processing_time") > 0) & (F.col("pending_urls") > 0),
        _minutes_after(as_of, F.col("average_processing_time") * F.col("pending_urls") / 60),
    )
    return agg.withColumn("progress_percentage", percent(F.col("completed_urls"), F.col("total_urls"))).withColumn(
        "estimated_completion", eta
    )


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100).otherwise(0.0)


def with_job_flags(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("progress_percentage", percent(F.col("completed_urls"), F.col("total_urls"))).withColumn(
        "is_complete", F.col("status").isin(*K.TERMINAL)
    )


def system_stats(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    def counts(df: DataFrame, entity: str) -> DataFrame:
        return df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(entity).alias("entity"), "status", "n")

    return counts(jobs, "job").unionByName(counts(tasks, "task"))


def high_failure_jobs(tasks: DataFrame, jobs: DataFrame | None = None, rate: float = 0.8, min_tasks: int = 10) -> DataFrame:
    """Jobs to be failed: more than ``min_tasks`` tasks and a failure share above ``rate``.

    With ``jobs`` given only those still processing are looked at.
    """
    agg = tasks.groupBy("job_id").agg(
        F.count("*").alias("total_tasks"), F.count_if(_is("failed")).alias("failed_tasks")
    )
    agg = agg.withColumn("failure_rate", F.col("failed_tasks") / F.col("total_tasks"))
    bad = agg.filter((F.col("failure_rate") > rate) & (F.col("total_tasks") > min_tasks))
    if jobs is not None:
        bad = bad.join(jobs.filter(_is("processing")).select("job_id"), "job_id", "left_semi")
    return bad.withColumn("new_status", F.lit("failed"))


def worker_distribution(tasks: DataFrame, results: DataFrame, score: str = "content_quality_score") -> DataFrame:
    """Per job and worker kind: tasks, mean score, quality tiers."""
    joined = tasks.join(results.select("task_id", score), "task_id", "left")
    t = S.tier(F.col(score))
    has = F.col(score).isNotNull()
    return joined.groupBy("job_id", "worker_type").agg(
        F.count("*").alias("n_tasks"),
        F.avg(score).alias("avg_score"),
        *[F.count_if(has & (t == name)).alias(f"{name}_quality") for name in ("high", "medium", "low")],
    )


def progress_lines(progress: DataFrame) -> DataFrame:
    """Log-style row per job."""
    return progress.select(
        "job_id",
        F.col("total_tasks").alias("total"),
        F.col("completed_tasks").alias("completed"),
        F.col("failed_tasks").alias("failed"),
        F.round(percent(F.col("completed_tasks"), F.col("total_tasks")), 2).alias("progress_percentage"),
    )


def bulk_outcome(outcomes: DataFrame) -> DataFrame:
    """success_count, failure_count and counts by message over per-id outcome rows.

    The messages themselves stay a table (``outcomes``), since their number grows with the request.
    """
    return outcomes.groupBy().agg(
        F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count")
    )

"""Changes to jobs, tasks and results as new tables.

Tables are immutable: every function returns the table after the change. Commands arrive
as a table too, so one job applies any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.operators.skew import join_lookup


def merge_rows(base: DataFrame, changes: DataFrame, key: str, version: str, deleted: str = "deleted") -> DataFrame:
    """Upserts and deletes from a change batch; the newest change of a key wins.

    ``changes`` has the columns of ``base`` plus ``version`` and a boolean ``deleted``.
    """
    cols = base.columns
    newest = (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*[c for c in cols if c != key], deleted), F.col(version)).alias("_c"))
        .select(key, "_c.*")
    )
    kept = base.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest.filter(~F.col(deleted)).select(*cols))


def latest_status(updates: DataFrame, key: str, version: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last known columns per key; an aggregate, so hot keys are combined on the map side."""
    return (
        updates.groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.struct(*version)).alias("_u"))
        .select(key, "_u.*")
    )


def can_retry(tasks: DataFrame) -> DataFrame:
    return tasks.filter((F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries")))


def without_result(tasks: DataFrame, results: DataFrame) -> DataFrame:
    return tasks.join(results, "task_id", "left_anti")


def retry_outcomes(ids: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, ok, message) for each requested id."""
    known = ids.select("task_id").join(tasks.select("task_id", "status"), "task_id", "left")
    shown = F.col("task_id").cast("string")
    return known.select(
        "task_id",
        (F.coalesce(F.col("status") == "failed", F.lit(False))).alias("ok"),
        F.when(F.col("status").isNull(), F.concat(F.lit("Task "), shown, F.lit(" not found")))
        .when(F.col("status") != "failed", F.concat(F.lit("Task "), shown, F.lit(" is not in failed status")))
        .alias("message"),
    )


def _flag(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a boolean column: is this key in ``ids``."""
    return join_lookup(df, ids.select(key).distinct().withColumn(name, F.lit(True)), [key]).withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def _set(df: DataFrame, hit: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items() if c in df.columns})


def retry_tasks(tasks: DataFrame, ids: DataFrame, reset_count: bool = False) -> DataFrame:
    """Failed tasks among ``ids`` go back to pending."""
    flagged = _flag(tasks, ids, "task_id", "_hit")
    hit = F.col("_hit") & (F.col("status") == "failed")
    none = F.lit(None)
    values = {"error_message": none, "started_at": none, "completed_at": none}
    if reset_count:
        values["retry_count"] = F.lit(0)
    # status last: the other columns test its old value
    return _set(_set(flagged, hit, **values), hit, status=F.lit("pending")).drop("_hit")


def cancel_outcomes(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    known = ids.select("job_id").distinct().join(jobs.select("job_id", "status"), "job_id", "left")
    finished = F.col("status").isin(*K.TERMINAL)
    return known.select(
        "job_id",
        F.coalesce(~finished, F.lit(False)).alias("ok"),
        F.when(F.col("status").isNull(), "Job not found").when(finished, "Job is already finished").alias("message"),
    )


def cancel_jobs(
    jobs: DataFrame, tasks: DataFrame, ids: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Running jobs become cancelled; their open tasks fail with "Cancelled by user"."""
    flagged = _flag(jobs, ids, "job_id", "_hit")
    hit = F.col("_hit") & ~F.col("status").isin(*K.TERMINAL)
    stopped = flagged.filter(hit).select("job_id")
    new_jobs = _set(_set(flagged, hit, completed_at=as_of, updated_at=as_of), hit, status=F.lit("cancelled"))
    task_flag = _flag(tasks, stopped, "job_id", "_stop")
    open_task = F.col("_stop") & F.col("status").isin("pending", "processing")
    changed = _set(task_flag, open_task, error_message=F.lit("Cancelled by user"), completed_at=as_of)
    return new_jobs.drop("_hit"), _set(changed, open_task, status=F.lit("failed")).drop("_stop")


TRANSITIONS = {"pause": ("processing", "paused"), "resume": ("paused", "processing")}


def pause_resume(jobs: DataFrame, commands: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``commands`` has (job_id, action) and may have ``version``; a job's command of the highest version counts
    (of equal ones the alphabetically first). Adds ``applied``."""
    version = F.col("version") if "version" in commands.columns else F.lit(0)
    latest = commands.groupBy("job_id").agg(F.min_by("action", F.struct(-version, "action")).alias("action"))
    joined = jobs.join(latest, "job_id", "left")
    new = F.lit(None).cast("string")
    for action, (before, after) in TRANSITIONS.items():
        new = F.when((F.col("action") == action) & (F.col("status") == before), after).otherwise(new)
    out = joined.withColumn("_new", new).withColumn("applied", F.col("_new").isNotNull())
    if as_of is not None:
        out = _set(out, F.col("applied"), updated_at=as_of)
    return out.withColumn("status", F.coalesce("_new", "status")).drop("_new", "action")


def rename_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` has job_id with new name / description and may have ``version``; null means unchanged.

    Of several updates of a job, each field's newest value counts (of equal versions the alphabetically last).
    """
    version = F.col("version") if "version" in updates.columns else F.lit(0)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(version, F.col(c)))).alias(f"_{c}")
    u = updates.groupBy("job_id").agg(newest("name"), newest("description"))
    return (
        jobs.join(u, "job_id", "left")
        .withColumn("name", F.coalesce("_name", "name"))
        .withColumn("description", F.coalesce("_description", "description"))
        .drop("_name", "_description")
    )


def delete_jobs(
    jobs: DataFrame, tasks: DataFrame, results: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs with their tasks and the results of those tasks removed."""
    gone = tasks.join(ids.select("job_id"), "job_id", "left_semi").select("task_id")
    return (
        jobs.join(ids, "job_id", "left_anti"),
        tasks.join(ids, "job_id", "left_anti"),
        results.join(gone, "task_id", "left_anti"),
    )


def reset_stalled(tasks: DataFrame, as_of: Column, after: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Tasks in processing since before ``as_of - after``: pending again, or failed at the retry limit."""
    hit = (F.col("status") == "processing") & (F.col("started_at") < as_of - F.expr(after))
    flagged = tasks.withColumn("stalled", F.coalesce(hit, F.lit(False)))
    s = F.col("stalled")
    spent = F.col("retry_count") + 1 >= F.col("max_retries")
    out = _set(flagged, s & spent, error_message=F.lit("Task stalled - exceeded maximum retries"))
    out = _set(out, s, started_at=F.lit(None), status=F.when(spent, "failed").otherwise("pending"))
    return _set(out, s, retry_count=F.col("retry_count") + 1)


def apply_retention(
    jobs: DataFrame, tasks: DataFrame, results: DataFrame, as_of: Column, keep: str = "INTERVAL 7 DAYS"
) -> dict[str, DataFrame]:
    """Finished jobs older than ``keep`` split from the rest: ``archived`` and kept tables."""
    old = F.col("status").isin(*K.TERMINAL) & F.coalesce(F.col("completed_at") < as_of - F.expr(keep), F.lit(False))
    archived = jobs.filter(old)
    kept_jobs, kept_tasks, kept_results = delete_jobs(jobs, tasks, results, archived.select("job_id"))
    return {"archived": archived, "jobs": kept_jobs, "tasks": kept_tasks, "results": kept_results}


def apply_commands(
    jobs: DataFrame, tasks: DataFrame, results: DataFrame, commands: DataFrame, as_of: Column
) -> dict[str, DataFrame]:
    """A table of commands (job_id, action, name, description) merged into new tables.

    Each job has at most one command per batch. ``outcomes`` says for each command
    whether it applied.
    """
    def of(action: str) -> DataFrame:
        return commands.filter(F.col("action") == action)

    known = commands.join(jobs.select("job_id", "status"), "job_id", "left")
    status = F.col("status")
    ok = (
        F.when(status.isNull(), False)
        .when(F.col("action") == "cancel", ~status.isin(*K.TERMINAL))
        .when(F.col("action") == "pause", status == "processing")
        .when(F.col("action") == "resume", status == "paused")
        .otherwise(F.col("action").isin("rename", "delete"))
    )
    outcomes = known.select("job_id", "action", ok.alias("ok"))
    renamed = rename_jobs(jobs, of("rename"))
    moved = pause_resume(renamed, commands.filter(F.col("action").isin("pause", "resume")), as_of).drop("applied")
    cancelled, new_tasks = cancel_jobs(moved, tasks, of("cancel"), as_of)
    j, t, r = delete_jobs(cancelled, new_tasks, results, of("delete").select("job_id"))
    return {"jobs": j, "tasks": t, "results": r, "outcomes": outcomes}

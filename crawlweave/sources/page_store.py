"""Partitioned storage of raw pages and extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions.urls import storage_domain

BUCKETS = 1024


def _layout(pages: DataFrame, ts: str, layout: str) -> tuple[DataFrame, list[str]]:
    df = pages.withColumn("domain", storage_domain(F.col("url"))).withColumn("date", F.to_date(ts))
    if layout == "domain":
        return df, ["domain", "date"]
    return df.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(BUCKETS)).cast("int")), ["date", "bucket"]


def write_pages(
    pages: DataFrame, path: str, ts: str = "scraped_at", layout: str = "domain", fmt: str = "parquet",
    mode: str = "append",
) -> None:
    """Folders by domain and day, or by day and domain bucket when there are very many domains.

    The rebalance hint lets AQE gather a folder's rows into files of good size and split
    a domain that is too large for one task.
    """
    df, parts = _layout(pages, ts, layout)
    df.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).format(fmt).save(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def pages_by_domain(pages: DataFrame, domain: str, limit: int = 100, unique: str = "url") -> DataFrame:
    """First pages of a domain by time; reads only the folders of that domain or bucket."""
    out = pages.filter(F.col("domain") == domain)
    if "bucket" in pages.columns:
        bucket = F.pmod(F.xxhash64(F.lit(domain)), F.lit(BUCKETS)).cast("int")
        out = out.filter(F.col("bucket") == bucket)
    return out.orderBy("scraped_at", "url", unique).limit(limit)


def write_ai_results(results: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Folders by day and hour; job, task, extraction type and score stay columns."""
    df = results.withColumn("date", F.to_date(ts)).withColumn("hour", F.hour(ts))
    df.hint("rebalance", "date", "hour").write.mode(mode).partitionBy("date", "hour").parquet(path)


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """json, csv or parquet; nested columns become JSON text in csv."""
    out = flatten_for_csv(df) if fmt == "csv" else df
    w = out.write.mode(mode).format(fmt)
    (w.option("header", "true") if fmt == "csv" else w).save(path)


def flatten_for_csv(df: DataFrame) -> DataFrame:
    def flat(name: str, kind: str) -> Column:
        nested = kind.startswith(("array", "map", "struct"))
        return (F.to_json(F.col(name)) if nested else F.col(name)).alias(name)

    return df.select(*[flat(f.name, f.dataType.simpleString()) for f in df.schema.fields])


EXPORT_FORMATS = ("json", "csv", "parquet")


def export_frame(
    tasks: DataFrame, results: DataFrame, job_id, include_failed: bool = False, quality_threshold: float | None = None
) -> DataFrame:
    """Rows of one job's export: tasks with their results, failed ones on request."""
    mine = tasks.filter(F.col("job_id") == job_id)
    mine = mine.filter(F.col("status").isin("completed", "failed") if include_failed else F.col("status") == "completed")
    clash = [c for c in results.columns if c in tasks.columns and c != "task_id"]
    out = mine.join(results.drop(*clash), "task_id", "left" if include_failed else "inner")
    if quality_threshold is not None:
        out = out.filter(F.col("content_quality_score") >= quality_threshold)
    return out


def export_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {EXPORT_FORMATS}")
    write_processed(df, path, fmt)

"""Fixed schemas of jobs, tasks, results and messages, and their storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS = (
    "job_id string, name string, description string, status string, file_path string, file_size int, "
    "file_type string, total_urls int, completed_urls int, failed_urls int, created_at timestamp, "
    "updated_at timestamp, started_at timestamp, completed_at timestamp, config variant, job_metadata variant"
)
TASKS = (
    "task_id string, job_id string, url string, status string, worker_type string, priority int, "
    "retry_count int, max_retries int, result_path string, status_code int, content_type string, "
    "content_length int, error_message string, error_type string, created_at timestamp, started_at timestamp, "
    "completed_at timestamp, duration_seconds double, config variant, task_metadata variant"
)
RESULTS = (
    "result_id string, task_id string, url string, title string, content string, html string, "
    "links array<string>, images array<string>, emails array<string>, phone_numbers array<string>, "
    "language string, keywords array<string>, description string, response_headers map<string,string>, "
    "cookies map<string,string>, javascript_errors array<string>, content_quality_score double, "
    "data_completeness double, extracted_at timestamp, processed_at timestamp, result_metadata variant"
)
MESSAGES = (
    "id string, queue string, data string, timestamp timestamp, retry_count int, max_retries int, priority int"
)
SCHEMAS = {"jobs": JOBS, "tasks": TASKS, "results": RESULTS, "messages": MESSAGES}

# --- fixed values: text length limits of the tables ---
LENGTH_LIMITS = {"name": 255, "file_path": 500, "url": 2000, "title": 500}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def open_tables(spark: SparkSession, path: str, views: bool = True) -> dict[str, DataFrame]:
    """The Parquet tables below ``path``, also as SQL views."""
    out = {}
    for name in SCHEMAS:
        df = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
        if views:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def write_by_month(tasks: DataFrame, path: str, ts: str = "created_at", mode: str = "overwrite") -> None:
    """Monthly partitions by creation time, so a date filter reads only its months."""
    df = tasks.withColumn("month", F.date_format(ts, "yyyy-MM"))
    df.hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def length_problems(df: DataFrame, limits: dict[str, int] = LENGTH_LIMITS) -> DataFrame:
    """Rows with a text longer than its column allows, and which one."""
    over = F.array_compact(
        F.array(*[F.when(F.length(c) > n, F.lit(c)) for c, n in limits.items() if c in df.columns])
    )
    return df.withColumn("too_long", over).filter(F.size("too_long") > 0)


def results_from_pages(extracted: DataFrame, score: str = "quality_score") -> DataFrame:
    """Result rows with quality and completeness from extracted pages."""
    from crawlweave.functions.scores import data_quality

    q = data_quality(F.col("url"), F.col("title"), F.col("text"))
    return extracted.withColumn("_q", q).select(
        F.md5(F.col("url")).alias("result_id"), *[c for c in ("page_id", "task_id") if c in extracted.columns],
        "url", "title", F.col("text").alias("content"), "links", "images", "emails", "phone_numbers", "language",
        F.col("meta_description").alias("description"), F.col("meta_keywords").alias("keywords"),
        F.col("_q.quality_score").alias("content_quality_score"),
        F.col("_q.completeness_score").alias("data_completeness"),
    )

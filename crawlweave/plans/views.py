"""Job, task, request and message views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.plans.registry import table

AS_OF = "2024-01-30 23:57:13"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks from events: one event is one task, its user is the job."""
    e = table(spark, folder, "events")
    status = (
        F.when(F.col("event_type").isin("view", "purchase"), "completed")
        .when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "processing")
        .otherwise("pending")
    )
    return e.select(
        F.col("event_id").alias("task_id"),
        F.col("user_id").alias("job_id"),
        status.alias("status"),
        F.when(status == "completed", F.col("value")).alias("duration_seconds"),
        F.col("ts").alias("created_at"),
        F.when(status != "pending", F.col("ts")).alias("started_at"),
        F.when(status.isin("completed", "failed"), F.col("ts")).alias("completed_at"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        (F.col("event_id") % 5 + 1).cast("int").alias("priority"),
        F.when(status == "failed", "fetch failed").alias("error_message"),
    )


TASKS_SQL = """
tasks AS (
  SELECT event_id AS task_id, user_id AS job_id, status,
         CASE WHEN status = 'completed' THEN value END AS duration_seconds,
         ts AS created_at,
         CASE WHEN status <> 'pending' THEN ts END AS started_at,
         CASE WHEN status IN ('completed', 'failed') THEN ts END AS completed_at,
         CAST(event_id % 4 AS INTEGER) AS retry_count, 3 AS max_retries,
         CAST(event_id % 5 + 1 AS INTEGER) AS priority,
         CASE WHEN status = 'failed' THEN 'fetch failed' END AS error_message
  FROM (SELECT *, CASE WHEN event_type IN ('view', 'purchase') THEN 'completed'
                       WHEN event_type = 'error' THEN 'failed'
                       WHEN event_type = 'click' THEN 'processing' ELSE 'pending' END AS status
        FROM events))"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One result per completed task, its score taken from the event value."""
    t = tasks(spark, folder).filter("status = 'completed'")
    return t.select("task_id", (F.col("task_id") % 101 / 100).alias("content_quality_score"), F.col("duration_seconds").alias("size"))


RESULTS_SQL = """
results AS (
  SELECT task_id, (task_id % 101) / 100.0 AS content_quality_score, duration_seconds AS size
  FROM tasks WHERE status = 'completed')"""


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs from orders."""
    o = table(spark, folder, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    )
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("name"),
        F.lit(None).cast("string").alias("description"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(status == "completed", F.col("o_orderdate")).alias("completed_at"),
    )


JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS job_id, o_orderpriority AS name, CAST(NULL AS VARCHAR) AS description,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status,
         o_orderdate AS created_at, o_orderdate AS updated_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at
  FROM orders)"""


def job_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of the order jobs from lineitem."""
    item = table(spark, folder, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("pending")
    return item.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"),
        F.col("l_orderkey").alias("job_id"),
        status.alias("status"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_shipdate").alias("completed_at"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("l_quantity").alias("duration_seconds"),
        F.element_at(F.array(F.lit("http"), F.lit("headless"), F.lit("crawl4ai")), (F.col("l_linenumber") % 3 + 1).cast("int"))
        .alias("worker_type"),
        F.col("l_linenumber").alias("priority"),
    )


JOB_TASKS_SQL = """
job_tasks AS (
  SELECT l_orderkey * 10 + l_linenumber AS task_id, l_orderkey AS job_id,
         CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'pending' END AS status,
         l_shipdate AS created_at, l_shipdate AS completed_at, CAST(NULL AS VARCHAR) AS error_message,
         l_quantity AS duration_seconds,
         CASE l_linenumber % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'headless' ELSE 'crawl4ai' END AS worker_type,
         l_linenumber AS priority
  FROM lineitem)"""


def job_results(spark: SparkSession, folder: str) -> DataFrame:
    """One result per completed lineitem task."""
    item = table(spark, folder, "lineitem").filter("l_linestatus = 'F'")
    return item.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"),
        (F.col("l_quantity") / 50).alias("content_quality_score"),
        F.col("l_extendedprice").alias("size"),
    )


JOB_RESULTS_SQL = """
job_results AS (
  SELECT l_orderkey * 10 + l_linenumber AS task_id, l_quantity / 50 AS content_quality_score, l_extendedprice AS size
  FROM lineitem WHERE l_linestatus = 'F')"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request log: source, success, response time."""
    return table(spark, folder, "events").select(
        "event_id", "ts",
        F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("source"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("response_time"),
    )


REQUESTS_SQL = """
requests AS (
  SELECT event_id, ts, 'p' || CAST(event_id % 7 AS VARCHAR) AS source,
         event_type <> 'error' AS success, value AS response_time
  FROM events)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Queue messages: the event type is the queue, every third is not acknowledged."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("queue"), F.col("user_id").alias("job_id"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"),
        (F.col("event_id") % 5 + 1).cast("int").alias("priority"),
        (F.col("event_id") % 3 != 0).alias("acked"), F.col("props").alias("data"),
    )


MESSAGES_SQL = """
messages AS (
  SELECT event_id AS id, ts, event_type AS queue, user_id AS job_id, CAST(event_id % 4 AS INTEGER) AS retry_count,
         3 AS max_retries, CAST(event_id % 5 + 1 AS INTEGER) AS priority, event_id % 3 <> 0 AS acked, props AS data
  FROM events)"""


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page with metadata, image, table, form and JSON-LD made from every document.

    Only letters, digits and spaces of the text's words are used, so the expected values
    are plain SQL over the documents.
    """
    w = F.regexp_replace("text", r"[^A-Za-z0-9 ]", "")
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", F.trim(F.regexp_replace(w, " +", " ")).alias("w"))
    s = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="'), F.col("lang"), F.lit('"><head><!-- <title>old</title> --><title> Page '), s, F.lit("</title>"),
        F.lit('<meta name="description" content="About '), F.col("source"), F.lit('">'),
        F.lit('<meta name="keywords" content="'), F.col("lang"), F.lit(", "), F.col("source"), F.lit(',,">'),
        F.lit('<meta property="og:title" content="Og '), s, F.lit('"><meta property="og:type" content="article">'),
        F.lit('<meta name="twitter:card" content="card-'), F.col("lang"), F.lit('">'),
        F.lit('<script type="application/ld+json">{"@type":"Article","name":"N'), s, F.lit('"}</script>'),
        F.lit('<script type="application/ld+json">{broken</script>'),
        F.lit('<script type="application/ld+json">{"name":"M'), s, F.lit('","id":'), s, F.lit("}</script></head><body>"),
        F.lit("<h1>Head "), s, F.lit("</h1><h2>Sub &amp; "), F.col("lang"), F.lit("</h2><h2> </h2>"),
        F.lit('<p class="lead">'), F.col("w"), F.lit("</p>"),
        F.lit('<img src="/img/'), s, F.lit('.png" alt="x" data-src="/lazy.png"><img data-src="/later.png" title="a src=/b.png"><img src="//cdn.example.com/a.png"><img src="data:x">'),
        F.lit("<ul><li>one "), s, F.lit("</li><li>two<ol><li>deep</li></ol></li></ul><ul></ul>"),
        F.lit("<table><tr><th>key</th><th>value</th></tr><tr><td>source</td><td>"), F.col("source"),
        F.lit("</td></tr></table>"),
        F.lit('<form action="/send" method="post"><input type="text" name="q"><select name="s"></select>'),
        F.lit('<textarea name="t"></textarea></form><form><input></form>'),
        F.lit('<a data-href="/no" href="../up/'), s, F.lit('">up</a><a href="?p=2">next</a><a href="#top">top</a>'),
        F.lit('<span id="price">'), s, F.lit(".5</span></body></html>"),
    )
    return d.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://site"), (F.col("doc_id") % 50).cast("string"), F.lit(".example.org/a/b/"), s).alias("url"),
        html.alias("html"),
    )


#: How signs are written in escaped pages; "&" comes first.
WRITTEN = (("&", "&amp;"), ("<", "&#60;"), (">", "&#x3E;"), ("é", "&eacute;"), ("ü", "&#252;"), ("ö", "&#XF6;"), ("ß", "&szlig;"), ("ñ", "&ntilde;"))


def escaped_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text as a page, with signs and accented letters written as character references."""
    body = F.coalesce("text", F.lit(""))
    for sign, written in WRITTEN:
        body = F.replace(body, F.lit(sign), F.lit(written))
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("page_id"), F.lit("https://site.example.org/").alias("url"), F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("html"))

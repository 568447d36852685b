"""Reader and writer queries. Files are written by Spark from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import urls as U
from crawlweave.operators import url_jobs as J
from crawlweave.plans import sqltext as S
from crawlweave.plans import views as V
from crawlweave.plans.registry import query, table
from crawlweave.session import fresh_path
from crawlweave.sources import page_store as PS
from crawlweave.sources import tables as TB
from crawlweave.sources import url_files as UF


@query("read_url_text", """SELECT 'line' AS kind, count(*) AS n FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT 'comma', 2 * count(*) FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT 'spaced', count(*) FROM pages WHERE page_id % 3 = 2""")
def read_url_text(spark, d):
    m = F.col("page_id") % 3
    u = F.col("url")
    line = (
        F.when(m == 0, F.concat(u, F.lit("#line"))).when(m == 1, F.concat(u, F.lit("#comma, "), u, F.lit("#comma")))
        .otherwise(F.concat(F.lit("see "), u, F.lit("#spaced now")))
    )
    p = table(spark, d, "pages").select(F.explode(F.array(line, F.lit(""), F.lit("# note"))).alias("value"))
    path = fresh_path(spark, "url-text")
    p.write.text(path)
    found = UF.read_url_text(spark, path)
    return found.groupBy(F.regexp_extract("url", "#([a-z]+)$", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("read_url_csv", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def read_url_csv(spark, d):
    path = fresh_path(spark, "url-csv")
    p = table(spark, d, "pages").select(F.col("page_id").alias("no"), F.concat(F.lit('say "'), "page_id", F.lit('", x')).alias("title"), "url")
    p.write.option("header", "true").option("sep", ";").option("escape", '"').csv(path)
    return UF.read_url_csv(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query("read_url_csv_simple", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def read_url_csv_simple(spark, d):
    path = fresh_path(spark, "url-csv")
    table(spark, d, "pages").select("url", F.lit("t").alias("title")).write.option("header", "true").csv(path)
    return UF.read_url_csv(spark, path, mode="simple").groupBy("url").agg(F.count("*").alias("n"))


@query("read_url_csv_multiline", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def read_url_csv_multiline(spark, d):
    """Notes with quotes, delimiters and line breaks before the URL."""
    path = fresh_path(spark, "url-csv")
    note = F.concat(F.lit('say "'), "page_id", F.lit('",\n\nor "'), F.col("page_id") % 7, F.lit('"\n, not'))
    p = table(spark, d, "pages").select(F.col("page_id").alias("no"), note.alias("note"), "url", F.lit("x\ny").alias("tail"))
    p.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    return UF.read_url_csv(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query("read_url_json_large", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def read_url_json_large(spark, d):
    """Arrays of a thousand objects or so, whose strings hold commas, brackets and quotes."""
    path = fresh_path(spark, "url-json")
    note = F.concat(F.lit('], {"no": '), "page_id", F.lit("}, ["))
    item = F.struct(note.alias("note"), F.array(F.col("page_id"), F.lit(2)).alias("list"), F.col("url").alias("link"))
    cut = (F.col("page_id") / 1000).cast("long")
    files = table(spark, d, "pages").groupBy(cut.alias("f")).agg(F.to_json(F.collect_list(item)).alias("value"))
    files.write.partitionBy("f").text(path)
    return _json_rows(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@query("read_url_json", "SELECT url, count(*) AS n FROM pages GROUP BY url")
def read_url_json(spark, d):
    """One JSON file per domain, of five shapes in turn."""
    path = fresh_path(spark, "url-json")
    m = F.abs(F.hash("domain")) % 5
    texts = F.to_json("urls")
    objects = F.to_json(F.transform("urls", lambda u: F.struct(u.alias("href"), F.lit(1).alias("priority"))))
    listed = F.to_json(F.transform("urls", lambda u: F.struct(u.alias("url"))))
    body = (
        F.when(m == 0, texts).when(m == 1, objects).when(m == 2, F.concat(F.lit('{"links":'), texts, F.lit(',"metadata":{}}')))
        .when(m == 3, F.concat(F.lit('{"sites":'), listed, F.lit("}"))).otherwise(F.concat(F.lit('{"link":'), texts, F.lit("}")))
    )
    # a domain's URLs are cut into lists of at most 100, as uploads are
    numbered = table(spark, d, "pages").select(U.domain(F.col("url")).alias("domain"), (F.col("page_id") / 100).cast("long").alias("cut"), "url")
    files = numbered.groupBy("domain", "cut").agg(F.collect_list("url").alias("urls")).select(body.alias("value"), F.concat_ws("-", "domain", "cut").alias("f"))
    files.write.partitionBy("f").text(path)
    return _json_rows(spark, path).groupBy("url").agg(F.count("*").alias("n"))


def _json_rows(spark, path):
    return UF.read_url_json(spark, path, glob="*.txt").filter("error IS NULL")


@query("read_url_json_errors", "SELECT page_id % 3 = 0 AS bad, count(*) AS n FROM pages GROUP BY 1")
def read_url_json_errors(spark, d):
    path = fresh_path(spark, "url-json")
    u = F.concat(F.lit('["'), "url", F.lit('"]'))
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("oops "), u)).otherwise(u)
    # one file a page, in one folder: a folder each would be made, listed and renamed one by one; a task's pages of one id share a file
    lines = F.array_join(F.collect_list(F.coalesce(body, F.lit(""))), "\n").alias("value")
    files = table(spark, d, "pages").withColumn("task", F.spark_partition_id()).groupBy("task", "page_id").agg(lines).select("value")
    files.write.option("maxRecordsPerFile", 1).text(path)
    return UF.read_url_json(spark, path, glob="*.txt").groupBy(F.col("error").isNotNull().alias("bad")).agg(F.count("*").alias("n"))


@query("url_inventory", f"SELECT {S.normalize('url')} AS norm_url, 2 * count(*) AS occurrences FROM pages WHERE {S.valid(S.normalize('url'))} GROUP BY 1")
def url_inventory(spark, d):
    """All files of a folder, text and CSV, in one job."""
    path = fresh_path(spark, "uploads")
    p = table(spark, d, "pages")
    p.select("url").write.text(f"{path}/lists")
    p.select("page_id", "url").write.option("header", "true").csv(f"{path}/sheets")
    found = UF.read_urls(spark, path).filter("error IS NULL")
    return J.clean_urls(found).select("norm_url", "occurrences")


@query("simple_urls", f"SELECT {S.normalize('url')} AS url, count(*) AS n FROM pages WHERE page_id % 2 = 1 AND {S.valid('url')} GROUP BY 1")
def simple_urls(spark, d):
    path = fresh_path(spark, "url-text")
    line = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    table(spark, d, "pages").select(line.alias("value")).write.text(path)
    return UF.simple_urls(UF.read_url_text(spark, path, "simple")).groupBy("url").agg(F.count("*").alias("n"))


@query("profile_url_files", "SELECT 'text/plain' AS mime, TRUE AS accepted, count(*) AS n_urls FROM pages UNION ALL SELECT 'text/csv', TRUE, count(*) FROM pages")
def profile_url_files(spark, d):
    path = fresh_path(spark, "uploads")
    p = table(spark, d, "pages")
    p.select("url").write.text(f"{path}/lists")
    p.select("page_id", "url").write.option("header", "true").csv(f"{path}/sheets")
    listing = UF.profile_files(spark, path).filter("suffix IN ('.txt', '.csv')")
    return listing.groupBy("mime", "accepted").agg(F.sum("n_urls").alias("n_urls"))


SCRAPED = "TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 3 AS INTEGER))"


def _stored_pages(spark, d, layout):
    path = fresh_path(spark, "pages")
    p = table(spark, d, "pages").select(
        "page_id", "url", "html", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("page_id") % 3).cast("int"))).alias("scraped_at"))
    PS.write_pages(p, path, layout=layout)
    return PS.read_pages(spark, path)


@query("page_store", f"SELECT replace({S.domain('url')}, 'www.', '') AS domain, CAST({SCRAPED} AS DATE) AS date, count(*) AS n FROM pages GROUP BY ALL")
def page_store(spark, d):
    return _stored_pages(spark, d, "domain").groupBy("domain", "date").agg(F.count("*").alias("n"))


@query("pages_by_domain", f"""WITH s AS (SELECT page_id, url, {SCRAPED} AS scraped_at, replace({S.domain('url')}, 'www.', '') AS domain FROM pages)
SELECT page_id, url FROM s WHERE domain = 'cheap-pills.example.com' ORDER BY scraped_at, url, page_id LIMIT 100""")
def pages_by_domain(spark, d):
    return PS.pages_by_domain(_stored_pages(spark, d, "bucket"), "cheap-pills.example.com", unique="page_id").select("page_id", "url")


@query("ai_result_store", """SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, event_type AS extraction_type, count(*) AS n, round(avg(value), 6) AS avg_score FROM events GROUP BY ALL""")
def ai_result_store(spark, d):
    path = fresh_path(spark, "ai")
    r = table(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("extraction_type"), "event_id", "value",
                                         F.struct(F.col("props").alias("raw")).alias("result"))
    PS.write_ai_results(r, path)
    return spark.read.parquet(path).groupBy("date", "hour", "extraction_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_score"))


EXPORT = f"""WITH {V.TASKS_SQL}, {V.RESULTS_SQL} SELECT t.task_id, t.status, content_quality_score FROM tasks t"""


@query("export_results_csv", f"{EXPORT} JOIN results r ON r.task_id = t.task_id WHERE t.job_id = 7 AND t.status = 'completed' AND content_quality_score >= 0.5")
def export_results_csv(spark, d):
    path = fresh_path(spark, "export")
    PS.export_results(PS.export_frame(V.tasks(spark, d), V.results(spark, d), 7, quality_threshold=0.5), path, "csv")
    return spark.read.option("header", "true").schema(
        PS.export_frame(V.tasks(spark, d), V.results(spark, d), 7).schema).csv(path).select("task_id", "status", "content_quality_score")


@query("export_results_json", f"{EXPORT} LEFT JOIN results r ON r.task_id = t.task_id WHERE t.job_id = 7 AND t.status IN ('completed', 'failed')")
def export_results_json(spark, d):
    path = fresh_path(spark, "export")
    PS.export_results(PS.export_frame(V.tasks(spark, d), V.results(spark, d), 7, include_failed=True), path, "json")
    return spark.read.schema("task_id long, status string, content_quality_score double").json(path)


@query("processed_output", f"SELECT doc_id, length({S.clean_content('text')}) AS n FROM documents")
def processed_output(spark, d):
    from crawlweave.operators.quality import process_records
    from crawlweave.plans.q_quality import doc_records

    path = fresh_path(spark, "processed")
    done = process_records(doc_records(spark, d).withColumn("url", F.coalesce("url", F.lit("https://x.example.com/"))))
    PS.write_processed(done, path, "parquet")
    return spark.read.parquet(path).select("doc_id", F.length("cleaned_content").alias("n"))


@query("tasks_by_month", """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1""")
def tasks_by_month(spark, d):
    path = fresh_path(spark, "tasks")
    TB.write_by_month(V.job_tasks(spark, d), path)
    back = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    return back.filter("month BETWEEN '1995-06' AND '1995-12'").groupBy("month").agg(F.count("*").alias("n"))


@query("results_table", f"""SELECT page_id, md5(url) AS result_id, round((CASE WHEN {S.valid('url')} THEN 0.2 ELSE 0 END) + (CASE WHEN length({S.page_title('html')}) > 10 THEN 0.3 ELSE 0 END)
  + (CASE WHEN length({S.page_text('html')}) > 100 THEN 0.5 ELSE 0 END), 6) AS content_quality_score FROM pages""")
def results_table(spark, d):
    from crawlweave.operators.page_jobs import extract_pages

    r = TB.results_from_pages(extract_pages(table(spark, d, "pages")))
    return r.select("page_id", "result_id", F.round("content_quality_score", 6).alias("content_quality_score"))


@query("length_problems", "SELECT doc_id, 'title' AS too_long FROM documents WHERE length(text) > 500")
def length_problems(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"), F.lit("https://a.example.com").alias("url"))
    return TB.length_problems(t).select("doc_id", F.array_join("too_long", ",").alias("too_long"))

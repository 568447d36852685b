"""URL, routing and link queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions import html as H
from crawlweave.functions import routing as R
from crawlweave.functions import urls as U
from crawlweave.operators import frontier as FR
from crawlweave.operators import url_jobs as J
from crawlweave.plans import sqltext as S
from crawlweave.plans import views as V
from crawlweave.plans.registry import query, table


def raw_urls(spark, d):
    """Messy URL lines made from pages: casing, ports, missing schemes, blanks, comments, copies."""
    p = table(spark, d, "pages")
    u, m = F.col("url"), F.col("page_id") % 8
    line = (
        F.when(m == 0, F.upper(F.regexp_replace("url", "[?#].*$", "")))
        .when(m == 1, F.regexp_replace("url", "^https?://", ""))
        .when(m == 2, F.concat(F.lit("  "), u, F.lit(" ")))
        .when(m == 3, F.concat(F.lit("# "), u))
        .when(m == 4, F.concat(F.regexp_replace("url", r"^(https?)://([^/]*).*$", "$1://$2:80"), F.lit("/x")))
        .when(m == 5, F.lit(""))
        .when(m == 6, F.concat(F.lit("not a url "), F.col("page_id").cast("string")))
        .otherwise(F.concat(F.lit("//"), F.regexp_replace("url", "^https?://", "")))
    )
    one = p.select(F.concat(F.lit("f"), (F.col("page_id") % 5).cast("string")).alias("file"),
                   (F.col("page_id") * 2).alias("pos"), line.alias("url"))
    two = p.select(F.concat(F.lit("f"), (F.col("page_id") % 5).cast("string")).alias("file"),
                   (F.col("page_id") * 2 + 1).alias("pos"), u.alias("url"))
    return one.unionByName(two)


RAW_URLS = r"""
raw AS (
  SELECT 'f' || CAST(page_id % 5 AS VARCHAR) AS file, page_id * 2 AS pos,
    CASE page_id % 8
      WHEN 0 THEN upper(regexp_replace(url, '[?#].*$', ''))
      WHEN 1 THEN regexp_replace(url, '^https?://', '')
      WHEN 2 THEN '  ' || url || ' '
      WHEN 3 THEN '# ' || url
      WHEN 4 THEN regexp_replace(url, '^(https?)://([^/]*).*$', '\1://\2:80') || '/x'
      WHEN 5 THEN ''
      WHEN 6 THEN 'not a url ' || CAST(page_id AS VARCHAR)
      ELSE '//' || regexp_replace(url, '^https?://', '') END AS url
  FROM pages
  UNION ALL
  SELECT 'f' || CAST(page_id % 5 AS VARCHAR), page_id * 2 + 1, url FROM pages),
trimmed AS (SELECT file, pos, trim(url, ' ') AS u FROM raw),
classified AS (
  SELECT file, pos, norm_url, CASE WHEN norm_url IS NULL THEN 'skipped' WHEN """ + S.valid("norm_url") + r""" THEN 'valid' ELSE 'invalid' END AS verdict
  FROM (SELECT file, pos, CASE WHEN NOT (u = '' OR starts_with(u, '#') OR starts_with(u, '//')) THEN """ + S.normalize("u") + r""" END AS norm_url FROM trimmed))
"""


@query("url_normalize", f"WITH {RAW_URLS} SELECT pos, norm_url, verdict FROM classified")
def url_normalize(spark, d):
    return J.classify_urls(raw_urls(spark, d)).select("pos", "norm_url", "verdict")


@query("url_clean_dedupe", f"WITH {RAW_URLS} SELECT norm_url, min(pos) AS first_pos, count(*) AS occurrences "
       "FROM classified WHERE verdict = 'valid' GROUP BY norm_url")
def url_clean_dedupe(spark, d):
    return J.clean_urls(raw_urls(spark, d), order=["pos"]).withColumnRenamed("first_seen", "first_pos")


@query("url_clean_dedupe_per_file", f"WITH {RAW_URLS} SELECT file, norm_url, min(pos) AS first_pos, count(*) AS occurrences "
       "FROM classified WHERE verdict = 'valid' GROUP BY file, norm_url")
def url_clean_dedupe_per_file(spark, d):
    return J.clean_urls(raw_urls(spark, d), order=["pos"], scope=["file"]).withColumnRenamed("first_seen", "first_pos")


@query("url_validation_stats", f"""WITH {RAW_URLS}
SELECT file, count(*) AS total, count(DISTINCT CASE WHEN verdict = 'valid' THEN norm_url END) AS valid,
       count(*) FILTER (verdict = 'invalid') AS invalid,
       count(*) FILTER (verdict = 'valid') - count(DISTINCT CASE WHEN verdict = 'valid' THEN norm_url END) AS duplicates
FROM classified GROUP BY file""")
def url_validation_stats(spark, d):
    return J.url_report(raw_urls(spark, d))


@query("url_features", f"""SELECT page_id, {S.domain('url')} AS domain,
  len(list_filter(string_split({S.uri('url', 3)}, '/'), lambda s: s <> '')) AS path_depth,
  {S.uri('url', 4)} <> '' AS has_query_params, lower({S.uri('url', 1)}) = 'https' AS is_secure FROM pages""")
def url_features(spark, d):
    return J.url_features(table(spark, d, "pages")).select("page_id", "domain", "path_depth", "has_query_params", "is_secure")


@query("url_domains", f"SELECT {S.domain('url')} AS domain, replace({S.domain('url')}, 'www.', '') AS storage_domain, "
       "count(*) AS n FROM pages GROUP BY ALL")
def url_domains(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(U.domain(F.col("url")).alias("domain"), U.storage_domain(F.col("url")).alias("storage_domain")).agg(
        F.count("*").alias("n"))


@query("url_hash", f"SELECT md5({S.normalize('url')}) AS url_hash, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1")
def url_hash(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(U.url_hash(F.col("url")).alias("url_hash")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query("path_template", f"""SELECT regexp_replace(regexp_replace({S.uri('url', 3)},
  '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '{{id}}', 'g'), '/[0-9]+', '/{{id}}', 'g') AS template,
  count(*) AS n FROM pages GROUP BY 1""")
def path_template(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(U.path_template(U.part(F.col("url"), 3)).alias("template")).agg(F.count("*").alias("n"))


@query("robots_filter", f"""
WITH hosts AS (SELECT DISTINCT {S.domain('url')} AS host FROM pages),
rules AS (SELECT host, ord, path, allow FROM hosts CROSS JOIN
  (VALUES (1, '/en/1', FALSE), (2, '/en', TRUE), (3, '/fr', FALSE), (4, '/es/2', FALSE)) r(ord, path, allow) WHERE length(host) % 2 = 0),
p AS (SELECT page_id, {S.domain('url')} AS host, {S.uri('url', 3)} AS path FROM pages)
SELECT page_id, coalesce((SELECT arg_min(allow, ord) FROM rules r WHERE r.host = p.host AND starts_with(p.path, r.path)), TRUE) AS allowed
FROM p""")
def robots_filter(spark, d):
    p = table(spark, d, "pages")
    lines = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(path).alias("path"), F.lit(a).alias("allow"))
                      for o, path, a in ((1, "/en/1", False), (2, "/en", True), (3, "/fr", False), (4, "/es/2", False))])
    rules = (
        p.select(U.domain(F.col("url")).alias("host")).distinct().filter(F.length("host") % 2 == 0)
        .select("host", F.lit("*").alias("agent"), F.explode(lines).alias("r")).select("host", "agent", "r.*")
    )
    return J.robots_filter(p, rules).select("page_id", "allowed")


@query("page_links", f"WITH {S.LINKS_SQL} SELECT page_id, link FROM links")
def page_links(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(H.links(H.live_markup(F.col("html")), F.col("url"))).alias("link"))


@query("page_links_shared", f"""WITH {S.LINKS_SQL}
SELECT DISTINCT page_id, CASE WHEN starts_with(h, 'http') OR regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h
   ELSE lower({S.uri('url', 1)}) || '://' || {S.uri('url', 2)} || h END AS link
FROM (SELECT page_id, url, {S.unescape('raw')} AS h FROM hrefs) WHERE NOT starts_with(h, '#')""")
def page_links_shared(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(H.links_shared(H.live_markup(F.col("html")), F.col("url"))).alias("link"))


@query("link_split", f"""WITH {S.LINKS_SQL}
SELECT page_id, count(*) AS links, count(*) FILTER ({S.domain('link')} = {S.domain('url')}) AS internal,
       count(*) FILTER ({S.domain('link')} <> {S.domain('url')}) AS external FROM links GROUP BY page_id""")
def link_split(spark, d):
    s = J.link_split(table(spark, d, "pages"))
    return s.filter(F.size("links") > 0).select(
        "page_id", F.size("links").alias("links"), F.size("internal").alias("internal"), F.size("external").alias("external"))


@query("link_graph", f"""WITH {S.LINKS_SQL},
e AS (SELECT {S.domain('url')} AS s, {S.domain('link')} AS t FROM links),
u AS (SELECT s AS domain, 1 AS o, 0 AS i, CAST(s = t AS INTEGER) AS own FROM e UNION ALL SELECT t, 0, 1, 0 FROM e)
SELECT domain, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(own) AS BIGINT) AS internal_links
FROM u GROUP BY domain""")
def link_graph(spark, d):
    return J.link_degrees(J.link_edges(table(spark, d, "pages")))


@query("top_linked", f"WITH {S.LINKS_SQL} SELECT link AS dst_url, count(*) AS n_links FROM links GROUP BY link ORDER BY n_links DESC, link LIMIT 20")
def top_linked(spark, d):
    return J.top_linked(J.link_edges(table(spark, d, "pages")))


ROUTE_INGEST = f"CASE WHEN {S.words_any('url', K.INGEST_SCRIPT_WORDS)} THEN 'headless' ELSE 'http' END"
ROUTE_SMART = (
    f"CASE WHEN {S.words_any('url', K.SMART_CONTENT_WORDS)} THEN 'crawl4ai' "
    f"WHEN {S.words_any('url', K.SMART_SCRIPT_WORDS)} THEN 'headless' ELSE 'http' END"
)
QUEUE = "CASE {w} WHEN 'headless' THEN 'scrape_headless' WHEN 'crawl4ai' THEN 'scrape_crawl4ai' ELSE 'scrape_http' END"


@query("route_ingest", f"SELECT page_id, {ROUTE_INGEST} AS worker FROM pages")
def route_ingest(spark, d):
    return table(spark, d, "pages").select("page_id", R.route_ingest(F.col("url"), R.empty_config()).alias("worker"))


@query("route_smart", f"SELECT page_id, {ROUTE_SMART} AS worker FROM pages")
def route_smart(spark, d):
    return table(spark, d, "pages").select("page_id", R.route_smart(F.col("url"), R.empty_config()).alias("worker"))


@query("task_priority", """SELECT page_id, CASE WHEN contains(url, 'blog.') OR contains(url, 'cheap-pills') THEN 5
  WHEN contains(lower(url || '.PDF'), '.pdf') AND page_id % 2 = 0 THEN 3 ELSE 1 END AS priority FROM pages""")
def task_priority(spark, d):
    cfg = F.from_json(F.lit('{"high_priority_domains": ["blog.", "cheap-pills"]}'), R.CONFIG)
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", R.priority(url, cfg).alias("priority"))


TASK_URLS = f"""
norm AS (SELECT page_id % 3 AS job_id, {S.normalize('url')} AS url, min(page_id) AS pos FROM pages WHERE {S.valid(S.normalize('url'))} GROUP BY 1, 2)"""


def job_urls(spark, d):
    """Distinct URLs of three jobs; one of them could as well hold nearly all rows."""
    p = table(spark, d, "pages").select((F.col("page_id") % 3).alias("job_id"), "url", F.col("page_id").alias("pos"))
    return J.clean_urls(p, order=["pos"], scope=["job_id"]).select(
        "job_id", F.col("norm_url").alias("url"), F.col("first_seen").alias("pos"))


@query("task_build", f"""WITH {TASK_URLS}
SELECT md5(CAST(job_id AS VARCHAR) || '|' || url) AS task_id, job_id, url, 'pending' AS status, {ROUTE_INGEST} AS worker_type,
  CASE WHEN {S.words_any('url', K.DOCUMENT_SUFFIXES)} THEN 3 ELSE 1 END AS priority,
  CAST(floor((row_number() OVER (PARTITION BY job_id ORDER BY pos) - 1) / 100) AS BIGINT) AS batch_no FROM norm""")
def task_build(spark, d):
    return FR.build_tasks(job_urls(spark, d), ["pos"]).select(
        "task_id", "job_id", "url", "status", "worker_type", "priority", "batch_no")


@query("task_messages", f"""WITH {TASK_URLS}
SELECT {QUEUE.format(w='w')} AS queue, priority, count(*) AS n FROM (
  SELECT {ROUTE_SMART} AS w, CASE WHEN {S.words_any('url', K.DOCUMENT_SUFFIXES)} THEN 3 ELSE 1 END AS priority FROM norm)
GROUP BY 1, 2""")
def task_messages(spark, d):
    tasks = FR.build_tasks(job_urls(spark, d), ["pos"], smart=True)
    return FR.task_messages(tasks).filter(F.length("data") > 0).groupBy("queue", "priority").agg(F.count("*").alias("n"))


@query("frontier_new_urls", f"""WITH {TASK_URLS}
SELECT job_id, url FROM norm WHERE (job_id, url) NOT IN (
  SELECT page_id % 3, {S.normalize('url')} FROM pages WHERE page_id % 4 = 0)""")
def frontier_new_urls(spark, d):
    known = table(spark, d, "pages").filter("page_id % 4 = 0").select((F.col("page_id") % 3).alias("job_id"), "url")
    return FR.new_urls(job_urls(spark, d), known).select("job_id", "url")


@query("frontier", f"""WITH {TASK_URLS},
fresh AS (SELECT * FROM norm WHERE NOT starts_with({S.uri('url', 3)}, '/de') AND (job_id, url) NOT IN (
  SELECT page_id % 3, {S.normalize('url')} FROM pages WHERE page_id % 4 = 0))
SELECT job_id, {ROUTE_INGEST} AS worker_type, count(*) AS n FROM fresh GROUP BY 1, 2""")
def frontier(spark, d):
    p = table(spark, d, "pages")
    known = p.filter("page_id % 4 = 0").select((F.col("page_id") % 3).alias("job_id"), "url")
    rules = p.select(U.domain(F.col("url")).alias("host")).distinct().select(
        "host", F.lit("*").alias("agent"), F.lit(1).alias("ord"), F.lit("/de").alias("path"), F.lit(False).alias("allow"))
    tasks = FR.frontier(job_urls(spark, d), known, rules, ["pos"])
    return tasks.groupBy("job_id", "worker_type").agg(F.count("*").alias("n"))


@query("balance_pending", f"""SELECT worker_type, {QUEUE.format(w='worker_type')} AS queue, count(*) AS n
FROM (SELECT {ROUTE_SMART} AS worker_type FROM pages WHERE page_id % 3 <> 0) GROUP BY 1, 2""")
def balance_pending(spark, d):
    t = table(spark, d, "pages").select("url", F.when(F.col("page_id") % 3 == 0, "completed").otherwise("pending").alias("status"))
    return FR.balance_pending(t).groupBy("worker_type", "queue").agg(F.count("*").alias("n"))


@query("ingest_rollup", f"""WITH {TASK_URLS},
made AS (SELECT job_id, count(*) AS n FROM norm GROUP BY job_id)
SELECT j.job_id, coalesce(n, 0) AS total_urls, coalesce(n, 0) AS tasks_created,
  CASE WHEN coalesce(n, 0) > 0 THEN 'processing' ELSE 'failed' END AS status
FROM (SELECT DISTINCT page_id % 5 AS job_id FROM pages) j LEFT JOIN made m ON j.job_id = m.job_id""")
def ingest_rollup(spark, d):
    p = table(spark, d, "pages")
    jobs = p.select((F.col("page_id") % 5).alias("job_id")).distinct()
    report = J.url_report(p.select((F.col("page_id") % 3).alias("job_id"), "url"), scope=["job_id"])
    return FR.ingest_rollup(jobs, report, FR.build_tasks(job_urls(spark, d), ["pos"])).select(
        "job_id", "total_urls", "tasks_created", "status")


@query("extraction_config_check", """SELECT page_id,
  CASE page_id % 6 WHEN 1 THEN 'llm_config required' WHEN 3 THEN 'semantic_filter required' WHEN 5 THEN 'timeout out of range' END AS reason,
  page_id % 6 NOT IN (1, 3, 5) AS valid FROM pages""")
def extraction_config_check(spark, d):
    m = F.col("page_id") % 6
    cfg = (
        F.when(m == 0, '{"extraction_strategy": "markdown", "timeout": 30}')
        .when(m == 1, '{"extraction_strategy": "llm"}')
        .when(m == 2, '{"extraction_strategy": "llm", "llm_config": {"provider": "p", "schema": {"fields": [{"name": "t", "selector": "h1", "type": "text"}]}}}')
        .when(m == 3, '{"extraction_strategy": "cosine"}')
        .when(m == 4, '{"extraction_strategy": "cosine", "semantic_filter": "news"}')
        .otherwise('{"timeout": 301}')
    )
    rows = table(spark, d, "pages").select("page_id", F.from_json(cfg, R.CONFIG).alias("config"))
    return FR.check_configs(rows).select("page_id", "reason", "valid")


@query("same_domain", f"""SELECT a.page_id, {S.domain('a.url')} = {S.domain('b.url')} AND {S.domain('a.url')} <> '' AS same
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 + a.page_id % 3""")
def same_domain(spark, d):
    """Each page with a later one."""
    p = table(spark, d, "pages")
    other = p.select((F.col("page_id")).alias("other"), F.upper(F.col("url")).alias("other_url"))
    pairs = p.join(other, F.col("other") == F.col("page_id") + 1 + F.col("page_id") % 3)
    return pairs.select("page_id", U.is_same_domain(F.col("url"), F.col("other_url")).alias("same"))


@query("task_message_bodies", f"""SELECT page_id AS id, {QUEUE.format(w="CASE page_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'headless' ELSE 'crawl4ai' END")} AS queue, page_id % 5 + 1 AS priority,
  '{{"task_id":' || page_id || ',"job_id":' || page_id % 7 || ',"url":' || to_json(url)::VARCHAR || ',"worker_type":"' || CASE page_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'headless' ELSE 'crawl4ai' END
  || '","priority":' || page_id % 5 + 1 || CASE WHEN page_id % 4 = 0 THEN '' ELSE ',"config":{{"timeout":' || CASE page_id % 4 WHEN 1 THEN 30 ELSE 10 END || ',"retries":' || CASE page_id % 4 WHEN 2 THEN 0 ELSE 3 END
  || ',"user_agent":"u","headers":{{}},"follow_redirects":' || CASE page_id % 4 WHEN 3 THEN 'false' ELSE 'true' END || '}}' END || '}}' AS data FROM pages""")
def task_message_bodies(spark, d):
    """Queue messages with their whole bodies; missing settings are filled, a task without settings has none."""
    m = F.col("page_id") % 4
    given = F.when(m > 0, F.struct(
        F.when(m > 1, F.lit(10)).alias("timeout"), F.when(m == 2, F.lit(0)).alias("retries"), F.lit("u").alias("user_agent"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(m == 3, F.lit(False)).alias("follow_redirects")))
    kind = F.when(F.col("page_id") % 3 == 0, "http").when(F.col("page_id") % 3 == 1, "headless").otherwise("crawl4ai")
    tasks = table(spark, d, "pages").withColumn("given", given).select(
        F.col("page_id").alias("task_id"), (F.col("page_id") % 7).alias("job_id"), "url", kind.alias("worker_type"), (F.col("page_id") % 5 + 1).alias("priority"),
        R.task_config(F.col("given")).alias("config"), F.lit(3).alias("max_retries"))
    return FR.task_messages(tasks).select("id", "queue", "priority", "data")

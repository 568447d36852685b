"""Classification, score and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions import html as H
from crawlweave.functions import scores as SC
from crawlweave.functions import text as X
from crawlweave.functions import urls as U
from crawlweave.operators import page_jobs as P
from crawlweave.operators import quality as Q
from crawlweave.plans import sqltext as S
from crawlweave.plans.q_text import LANG_LETTERS
from crawlweave.plans.registry import query, table

TYPE_COLUMNS = f"""{S.hits('c', K.PRODUCT_WORDS)} AS hp, {S.hits('c', K.CONTACT_WORDS)} AS hc, {S.hits('c', K.NEWS_WORDS)} AS hn"""
TYPE = ("CASE WHEN greatest(hp, hc, hn) = 0 THEN 'article' WHEN hp = greatest(hp, hc, hn) THEN 'product' "
        "WHEN hc = greatest(hp, hc, hn) THEN 'contact' ELSE 'news' END")


def doc_records(spark, d):
    """Documents as fetched records: url, title, content and some links."""
    s = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("https://docs.example.com/a/"), s)).alias("url"),
        F.left("text", F.lit(12)).alias("title"),
        F.col("text").alias("content"),
        F.transform(F.sequence(F.lit(0), F.col("doc_id") % 8), lambda i: F.concat(F.lit("l"), i.cast("string"))).alias("links"),
    )


@query("content_type", f"""WITH c AS (SELECT doc_id, {TYPE_COLUMNS} FROM (SELECT doc_id, {S.clean_content('text')} AS c FROM documents))
SELECT doc_id, {TYPE} AS content_type, round(least(greatest(hp, hc, hn) / 10.0, 1.0), 6) AS confidence_score FROM c""")
def content_type(spark, d):
    t = Q.classify_text(table(spark, d, "documents").withColumn("c", X.clean_content(F.col("text"))), "c")
    return t.select(
        "doc_id", "content_analysis.content_type", F.round("content_analysis.confidence_score", 6).alias("confidence_score"))


METRICS = f"""
base AS (SELECT doc_id, doc_id % 8 + 1 AS n_links, text, {S.clean_content('text')} AS t FROM documents),
m AS (SELECT doc_id, length(text) AS raw_chars, length(t) AS clean_chars, len({S.word_list('t')}) AS words, n_links, {S.entity_size_columns('t')} FROM base),
q AS (SELECT *, (least(words / 100.0, 1.0) + least(n_keywords / 10.0, 1.0) + CASE WHEN n_emails > 0 OR n_phone_numbers > 0 THEN 1.0 ELSE 0.0 END
   + least(n_links / 5.0, 1.0)) / 4 AS overall FROM m)"""


@query("quality_metrics", f"""WITH {METRICS}
SELECT doc_id, round(CASE WHEN raw_chars > 0 THEN clean_chars / raw_chars ELSE 0 END, 6) AS content_retention,
  round((n_emails + n_phone_numbers + n_urls + n_social_handles + n_companies + n_locations + n_keywords) / greatest(words, 1), 6) AS information_density,
  round(overall, 6) AS overall_quality,
  round((CAST(n_emails > 0 AS INTEGER) + CAST(n_phone_numbers > 0 AS INTEGER) + CAST(n_urls > 0 AS INTEGER) + CAST(n_social_handles > 0 AS INTEGER)
    + CAST(n_companies > 0 AS INTEGER) + CAST(n_locations > 0 AS INTEGER) + CAST(n_keywords > 0 AS INTEGER)) / 7.0, 6) AS entity_richness,
  round(greatest(0, overall - 0.5) * 2, 6) AS processing_improvement FROM q""")
def quality_metrics(spark, d):
    q = Q.with_quality(doc_records(spark, d))
    names = ["content_retention", "information_density", "overall_quality", "entity_richness", "processing_improvement"]
    return q.select("doc_id", *[F.round(f"quality.{n}", 6).alias(n) for n in names])


@query("data_quality", f"""SELECT page_id, round((CASE WHEN {S.valid('url')} THEN 0.2 ELSE 0 END) + (CASE WHEN length(t) > 10 THEN 0.3 ELSE 0 END)
  + (CASE WHEN length(x) > 100 THEN 0.5 ELSE 0 END), 6) AS quality_score,
  round((CAST(url <> '' AS INTEGER) + CAST(t <> '' AS INTEGER) + CAST(x <> '' AS INTEGER)) / 3.0, 6) AS completeness_score
FROM (SELECT page_id, url, {S.page_title('html')} AS t, {S.page_text('html')} AS x FROM pages)""")
def data_quality(spark, d):
    p = P.extract_pages(table(spark, d, "pages"))
    q = SC.data_quality(F.col("url"), F.col("title"), F.col("text"))
    return p.select("page_id", q.alias("q")).select(
        "page_id", F.round("q.quality_score", 6).alias("quality_score"), F.round("q.completeness_score", 6).alias("completeness_score"))


STATUS = "CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 404 ELSE 200 END"
PAGE_SCORE = f"""
n AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id),
s AS (SELECT p.page_id, length({S.page_title('html')}) AS tl, length({S.page_text('html')}) AS cl, coalesce(n, 0) AS nl, {STATUS.replace('page_id', 'p.page_id')} AS st,
   p.page_id % 11 <> 0 AS ok FROM pages p LEFT JOIN n ON p.page_id = n.page_id),
scored AS (SELECT page_id, CASE WHEN ok THEN ((CASE WHEN tl = 0 THEN 0 WHEN tl BETWEEN 10 AND 100 THEN 20 WHEN tl > 100 THEN 15 ELSE 10 END)
  + (CASE WHEN cl = 0 THEN 0 WHEN cl > 1000 THEN 40 WHEN cl > 500 THEN 30 WHEN cl > 100 THEN 20 ELSE 10 END)
  + (CASE WHEN nl > 10 THEN 20 WHEN nl > 5 THEN 15 WHEN nl > 0 THEN 10 ELSE 0 END)
  + (CASE WHEN st = 200 THEN 20 WHEN st BETWEEN 200 AND 299 THEN 15 WHEN st BETWEEN 300 AND 399 THEN 10 ELSE 0 END)) / 100.0 ELSE 0.0 END AS score FROM s)"""


def scored_pages(spark, d):
    m = F.col("page_id") % 5
    p = table(spark, d, "pages").withColumn(
        "status_code", F.when(m == 1, 204).when(m == 2, 301).when(m == 3, 404).otherwise(200))
    x = P.extract_pages(p)
    score = SC.page_score(F.col("page_id") % 11 != 0, F.col("title"), F.col("text"), F.size("links"), F.col("status_code"))
    return x.select("page_id", "url", score.alias("score"))


@query("page_score", f"WITH {S.LINKS_SQL}, {PAGE_SCORE} SELECT page_id, round(score, 6) AS score FROM scored")
def page_score(spark, d):
    return scored_pages(spark, d).select("page_id", F.round("score", 6).alias("score"))


@query("quality_tiers", f"""WITH {S.LINKS_SQL}, {PAGE_SCORE}
SELECT CASE WHEN score >= 0.77 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM scored GROUP BY 1""")
def quality_tiers(spark, d):
    return scored_pages(spark, d).groupBy(SC.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"))


@query("ai_score", """SELECT conv_id, turn, round(CASE WHEN turn % 3 = 2 OR text = '' THEN 0 ELSE least(1.0, 0.3
  + CASE WHEN length(text) > 1000 THEN 0.25 WHEN length(text) > 500 THEN 0.15 WHEN length(text) > 100 THEN 0.05 ELSE 0 END
  + CASE WHEN role = 'user' THEN 0.2 ELSE 0 END + least(0.15, (conv_id % 12) * 0.02) + least(0.1, (turn % 15) * 0.01)) END, 6) AS score FROM conversations""")
def ai_score(spark, d):
    s = SC.ai_score(F.col("turn") % 3 != 2, F.col("text"), F.col("role") == "user", F.col("conv_id") % 12, F.col("turn") % 15)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(s, 6).alias("score"))


@query("enhancements", f"""SELECT doc_id, 'docs.example.com' AS domain, 2 AS path_depth, FALSE AS has_query_params, TRUE AS is_secure,
  len({S.word_list('text')}) AS word_count, CASE WHEN len(list_distinct(list_filter(regexp_split_to_array(lower(text), {S.q(K.WS + '+')}),
  lambda w: w IN {S.in_list(K.ENGLISH_WORDS)}))) > 5 THEN 'en' ELSE 'unknown' END AS language FROM documents WHERE doc_id % 7 <> 0""")
def enhancements(spark, d):
    r = Q.process_records(doc_records(spark, d)).filter("success")
    e = "enhancements"
    return r.select(
        "doc_id", f"{e}.url_analysis.domain", f"{e}.url_analysis.path_depth", f"{e}.url_analysis.has_query_params",
        f"{e}.url_analysis.is_secure", f"{e}.content_stats.word_count", f"{e}.language")


@query("process_records", f"""WITH {METRICS}, ty AS (SELECT doc_id, {TYPE_COLUMNS} FROM (SELECT doc_id, t AS c FROM base))
SELECT q.doc_id, q.doc_id % 7 <> 0 AS success, CASE WHEN q.doc_id % 7 = 0 THEN 'Unknown' ELSE 'https://docs.example.com/a/' || CAST(q.doc_id AS VARCHAR) END AS original_url,
  CASE WHEN q.doc_id % 7 = 0 THEN 0 ELSE clean_chars END AS processed_data_size,
  CASE WHEN q.doc_id % 7 <> 0 THEN n_keywords END AS n_keywords, CASE WHEN q.doc_id % 7 <> 0 THEN round(overall, 6) END AS overall_quality,
  CASE WHEN q.doc_id % 7 <> 0 THEN {TYPE} END AS content_type
FROM q JOIN ty ON q.doc_id = ty.doc_id""")
def process_records(spark, d):
    r = Q.process_records(doc_records(spark, d))
    return r.select(
        "doc_id", "success", "original_url", "processed_data_size",
        F.when(F.col("success"), F.size(F.col("extracted_entities")["keywords"])).alias("n_keywords"),
        F.round("quality_metrics.overall_quality", 6).alias("overall_quality"), "content_analysis.content_type")


DOMAIN_REPORT = f"""WITH {S.LINKS_SQL},
n AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id),
base AS (SELECT p.page_id, {S.domain('p.url')} AS domain, p.url, {S.page_title('html')} AS title, {S.page_text('html')} AS text, coalesce(n, 0) AS n_links
  FROM pages p LEFT JOIN n ON p.page_id = n.page_id),
c AS (SELECT *, {S.clean_content('text')} AS t FROM base),
m AS (SELECT page_id, domain, url, title, text, n_links, t AS c, len({S.word_list('t')}) AS words, {S.entity_size_columns('t')} FROM c),
s AS (SELECT domain, n_links, {LANG_LETTERS} AS language, {TYPE_COLUMNS}, sha256(lower({S.clean_text('text')})) AS h,
  (least(words / 100.0, 1.0) + least(n_keywords / 10.0, 1.0) + CASE WHEN n_emails > 0 OR n_phone_numbers > 0 THEN 1.0 ELSE 0.0 END + least(n_links / 5.0, 1.0)) / 4 AS q,
  (CASE WHEN {S.valid('url')} THEN 0.2 ELSE 0 END) + (CASE WHEN length(title) > 10 THEN 0.3 ELSE 0 END) + (CASE WHEN length(text) > 100 THEN 0.5 ELSE 0 END) AS dq FROM m),
k AS (SELECT domain, {TYPE} AS kind, n_links, h, q, dq, language FROM s),
best AS (SELECT domain, kind FROM (SELECT domain, kind, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, kind) AS r FROM k GROUP BY domain, kind) WHERE r = 1)
SELECT k.domain, count(*) AS pages, round(avg(q), 5) AS avg_quality, round(avg(dq), 5) AS avg_data_quality, CAST(sum(n_links) AS BIGINT) AS links,
  count(*) - count(DISTINCT h) AS copies, any_value(best.kind) AS top_type, string_agg(DISTINCT language, ',' ORDER BY language) AS languages
FROM k JOIN best ON k.domain = best.domain GROUP BY k.domain"""


@query("domain_report", DOMAIN_REPORT)
def domain_report(spark, d):
    p = table(spark, d, "pages")
    body = F.col("html")
    live = F.col("live")
    records = p.withColumn("live", H.live_markup(body)).select(
        "page_id", "url", H.title(live).alias("title"), H.visible_text(body).alias("content"), H.links(live, F.col("url")).alias("links"))
    r = Q.domain_report(records)
    return r.withColumn("avg_quality", F.round("avg_quality", 5)).withColumn("avg_data_quality", F.round("avg_data_quality", 5))


@query("label_agreement", f"""WITH m AS (SELECT d.doc_id, l.quality AS quality_label, length(text) AS raw_chars, length({S.clean_content('text')}) AS clean_chars,
  len({S.word_list(S.clean_content('text'))}) AS words, {S.entity_size_columns('text')} FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
q AS (SELECT *, (least(words / 100.0, 1.0) + least(n_keywords / 10.0, 1.0) + CASE WHEN n_emails > 0 OR n_phone_numbers > 0 THEN 1.0 ELSE 0.0 END) / 4 AS overall FROM m)
SELECT quality_label, count(*) AS n_docs, round(avg(overall), 5) AS avg_quality,
  round(avg((n_emails + n_phone_numbers + n_urls + n_social_handles + n_companies + n_locations + n_keywords) / greatest(words, 1)), 5) AS avg_density,
  round(avg(clean_chars / raw_chars), 5) AS avg_retention FROM q GROUP BY quality_label""")
def label_agreement(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("quality_label"))
    r = Q.label_agreement(table(spark, d, "documents"), labels)
    return r.select("quality_label", "n_docs", *[F.round(c, 5).alias(c) for c in ("avg_quality", "avg_density", "avg_retention")])

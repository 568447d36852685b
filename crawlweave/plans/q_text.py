"""Text queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions import text as X
from crawlweave.operators import corpus as C
from crawlweave.operators import search as SR
from crawlweave.operators import word_index as WX
from crawlweave.plans import sqltext as S
from crawlweave.plans.registry import query, table
from crawlweave.session import fresh_path


def docs(spark, d):
    return table(spark, d, "documents")


@query("clean_text", f"SELECT doc_id, md5({S.clean_text('text')}) AS clean_md5, length({S.clean_text('text')}) AS n FROM documents")
def clean_text(spark, d):
    c = C.clean_corpus(docs(spark, d))
    return c.select("doc_id", F.md5("clean_text").alias("clean_md5"), F.length("clean_text").alias("n"))


@query("clean_content", f"SELECT doc_id, md5({S.clean_content('text')}) AS clean_md5, length({S.clean_content('text')}) AS n FROM documents")
def clean_content(spark, d):
    c = C.clean_corpus(docs(spark, d))
    return c.select("doc_id", F.md5("clean_content").alias("clean_md5"), F.length("clean_content").alias("n"))


TITLED = (
    "CASE doc_id % 6 WHEN 0 THEN left(text, 30) || ' | Home' WHEN 1 THEN left(text, 30) || ' - Home - Homepage' "
    "WHEN 2 THEN left(text, 30) || ' - Official Website' WHEN 3 THEN left(text, 30) || ' - Homepage - Home' "
    "WHEN 4 THEN '  ' || left(text, 30) || ' - Official Site' ELSE left(text, 30) END"
)


@query("clean_title", f"SELECT doc_id, {S.SUFFIX_FREE.replace('{x}', S.title_cut('t'))} AS title FROM (SELECT doc_id, {TITLED} AS t FROM documents)")
def clean_title(spark, d):
    m, head = F.col("doc_id") % 6, F.left("text", F.lit(30))
    t = (
        F.when(m == 0, F.concat(head, F.lit(" | Home"))).when(m == 1, F.concat(head, F.lit(" - Home - Homepage")))
        .when(m == 2, F.concat(head, F.lit(" - Official Website"))).when(m == 3, F.concat(head, F.lit(" - Homepage - Home")))
        .when(m == 4, F.concat(F.lit("  "), head, F.lit(" - Official Site"))).otherwise(head)
    )
    return docs(spark, d).select("doc_id", X.clean_title(t).alias("title"))


def _rows(kind):
    return lambda spark, d: C.entities_long(docs(spark, d), [kind]).select("doc_id", "value")


def _distinct_sql(expr):
    return f"SELECT DISTINCT doc_id, unnest({expr}) AS value FROM documents"


EDGED = S.ascii_edges("text")
COMPANIES = " || ".join(S.all_of(EDGED, p, 1) for p in K.COMPANY_PATTERNS)
PLACES = " || ".join(S.all_of(EDGED, p, 1) for p in K.PLACE_PATTERNS)

query("emails", _distinct_sql(S.all_of(EDGED, K.EMAIL)))(_rows("emails"))
query("phones_us", f"SELECT doc_id, {S.us_phone('m')} AS value FROM (SELECT doc_id, unnest({S.all_of('text', K.PHONE_US)}) AS m FROM documents)")(
    _rows("phone_numbers"))
query("text_urls", _distinct_sql(S.all_of("text", K.TEXT_URL)))(_rows("urls"))
query("social_handles", _distinct_sql(S.all_of("text", K.SOCIAL, 1)))(_rows("social_handles"))
query("companies", _distinct_sql(f"list_filter({COMPANIES}, lambda c: length(c) > 2)"))(_rows("companies"))
query("locations", _distinct_sql(PLACES))(_rows("locations"))


@query("phones_multi", f"""SELECT DISTINCT doc_id, value FROM (
  SELECT doc_id, right(regexp_replace(unnest({S.all_of('text', K.PHONE_MULTI_US)}), '[^0-9]', '', 'g'), 10) AS value FROM documents
  UNION ALL SELECT doc_id, regexp_replace(unnest({S.all_of('text', K.PHONE_MULTI_INTL)}), '[^0-9]', '', 'g') FROM documents
  UNION ALL SELECT doc_id, unnest({S.all_of('text', K.PHONE_MULTI_DASHED)}) FROM documents
  UNION ALL SELECT doc_id, unnest({S.all_of('text', K.PHONE_MULTI_PAREN)}) FROM documents)""")
def phones_multi(spark, d):
    return docs(spark, d).select("doc_id", F.explode(X.phones_multi(F.col("text"))).alias("value"))


@query("entities_cleaned", f"""WITH c AS (SELECT doc_id, {S.clean_content('text')} AS t FROM documents), e AS (SELECT doc_id, {S.entity_size_columns('t')} FROM c)
SELECT doc_id, n_emails, n_phone_numbers, n_urls, n_social_handles, n_companies, n_locations, n_keywords FROM e""")
def entities_cleaned(spark, d):
    c = docs(spark, d).withColumn("c", X.clean_content(F.col("text")))
    e = c.select("doc_id", X.entities(F.col("c")).alias("e"))
    return e.select("doc_id", *[F.size(F.col("e")[k]).alias(f"n_{k}") for k in X.ENTITY_KINDS])


@query("entities_raw", f"""SELECT doc_id, {S.entity_size_columns('text')} FROM documents""")
def entities_raw(spark, d):
    e = docs(spark, d).select("doc_id", X.entities(F.col("text")).alias("e"))
    return e.select("doc_id", *[F.size(F.col("e")[k]).alias(f"n_{k}") for k in X.ENTITY_KINDS])


@query("contact_index", f"""SELECT kind, value, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM (
  SELECT doc_id, 'emails' AS kind, unnest({S.all_of(EDGED, K.EMAIL)}) AS value FROM documents
  UNION ALL SELECT doc_id, 'phone_numbers', {S.us_phone('m')} FROM (SELECT doc_id, unnest({S.all_of('text', K.PHONE_US)}) AS m FROM documents)
  UNION ALL SELECT doc_id, 'urls', unnest({S.all_of('text', K.TEXT_URL)}) FROM documents
  UNION ALL SELECT doc_id, 'social_handles', unnest({S.all_of('text', K.SOCIAL, 1)}) FROM documents)
GROUP BY kind, value""")
def contact_index(spark, d):
    return C.contact_index(docs(spark, d))


@query("entity_index", f"""WITH c AS ({_distinct_sql(f"list_filter({COMPANIES}, lambda c: length(c) > 2)")}), l AS ({_distinct_sql(PLACES)})
SELECT kind, value, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM (
  SELECT 'companies' AS kind, * FROM c UNION ALL SELECT 'locations', * FROM l) GROUP BY kind, value""")
def entity_index(spark, d):
    return C.entity_index(docs(spark, d))


def _ranked(src, key):
    return (
        f"WITH w AS ({S.keyword_rows(src, key, 'text')}), c AS (SELECT {key}, word, count(*) AS n FROM w GROUP BY {key}, word) "
        f"SELECT * FROM (SELECT {key}, word, n, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 20"
    )


@query("keywords_topk", f"SELECT doc_id, rank, word FROM ({_ranked('documents', 'doc_id')})")
def keywords_topk(spark, d):
    return C.doc_keywords(docs(spark, d))


@query("keywords_by_source", _ranked("documents", "source"))
def keywords_by_source(spark, d):
    return C.keyword_ranking(docs(spark, d), "source")


@query("document_frequency", f"""WITH w AS ({S.keyword_rows('documents', 'doc_id', 'text')})
SELECT word, count(DISTINCT doc_id) AS n_docs, count(*) AS n_total FROM w GROUP BY word""")
def document_frequency(spark, d):
    return C.document_frequency(docs(spark, d))


LANG_WORDS = (
    f"CASE WHEN len(list_distinct(list_filter(regexp_split_to_array(lower(text), {S.q(K.WS + '+')}), lambda w: w IN {S.in_list(K.ENGLISH_WORDS)}))) > 5 "
    "THEN 'en' ELSE 'unknown' END"
)
LANG_LETTERS = (
    f"CASE WHEN length({S.clean_text('text')}) < 100 THEN 'unknown' WHEN regexp_matches(text, '[αβγδεζηθικλμνξοπρστυφχψω]') THEN 'el' "
    "WHEN regexp_matches(text, '[àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]') THEN 'fr' WHEN regexp_matches(text, '[äöüß]') THEN 'de' ELSE 'en' END"
)


@query("lang_stopwords", f"SELECT doc_id, {LANG_WORDS} AS language FROM documents")
def lang_stopwords(spark, d):
    return docs(spark, d).select("doc_id", X.language_by_words(F.col("text")).alias("language"))


@query("lang_charset", f"SELECT doc_id, {LANG_LETTERS} AS language FROM documents")
def lang_charset(spark, d):
    c = docs(spark, d).withColumn("c", X.clean_text(F.col("text")))
    return c.select("doc_id", X.language_by_letters(F.col("c")).alias("language"))


@query("language_report", f"""SELECT source, lang, {LANG_WORDS} AS lang_by_words, {LANG_LETTERS} AS lang_by_letters, count(*) AS n_docs
FROM documents GROUP BY ALL""")
def language_report(spark, d):
    return C.language_report(docs(spark, d))


STATS = f"""stats AS (SELECT doc_id, source, len({S.word_list('text')}) AS word_count, length(text) AS char_count,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10) || chr(10))) END AS paragraph_count,
  CASE WHEN text = '' THEN 0 ELSE greatest(1, len({S.word_list('text')}) // 200) END AS reading_time_minutes FROM documents)"""


@query("content_stats", f"WITH {STATS} SELECT * FROM stats")
def content_stats(spark, d):
    return C.content_stats(docs(spark, d))


@query("corpus_stats", f"""WITH {STATS} SELECT source, count(*) AS n_docs, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(char_count) AS BIGINT) AS chars,
  CAST(sum(paragraph_count) AS BIGINT) AS paragraphs, CAST(sum(reading_time_minutes) AS BIGINT) AS reading_minutes,
  round(quantile_cont(word_count, 0.5), 6) AS p50, round(quantile_cont(word_count, 0.95), 6) AS p95 FROM stats GROUP BY source""")
def corpus_stats(spark, d):
    c = C.corpus_stats(docs(spark, d))
    return c.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


HASHED = f"h AS (SELECT doc_id, sha256(lower({S.clean_text('text')})) AS content_hash FROM documents)"


@query("content_hash", f"WITH {HASHED} SELECT content_hash, min(doc_id) AS first_doc, count(*) AS n_docs FROM h GROUP BY content_hash")
def content_hash(spark, d):
    return C.duplicate_groups(docs(spark, d))


@query("content_dedupe", f"""WITH {HASHED}, g AS (SELECT content_hash, min(doc_id) AS first_doc, count(*) AS n_docs FROM h GROUP BY content_hash)
SELECT doc_id, first_doc, n_docs, doc_id = first_doc AS kept FROM h JOIN g USING (content_hash)""")
def content_dedupe(spark, d):
    return C.dedupe_content(docs(spark, d)).drop("content_hash")


@query("stored_values", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def stored_values(spark, d):
    v = X.parse_value(F.col("props"))
    return table(spark, d, "events").select("event_id", F.variant_get(v, "$.k", "long").alias("k"))


@query("word_search", f"""SELECT doc_id, len(h) AS hits FROM (SELECT doc_id, list_filter({S.all_of('lower(text)', K.TOKEN)}, lambda t: t IN ('the', 'with')) AS h FROM documents)
WHERE len(list_distinct(h)) = 2""")
def word_search(spark, d):
    return SR.word_search(docs(spark, d), ["the", "with"])


@query("token_table", f"""SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.all_of('lower(text)', K.TOKEN)}) AS term FROM documents) GROUP BY ALL) GROUP BY term""")
def token_table(spark, d):
    return SR.token_table(docs(spark, d)).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


# every text with two URLs and three places after it, which the given texts lack
PLANTED = (
    "concat(coalesce(text, ''), ' see http://', source, '.org/d/', doc_id, '?q=a+b, (https://x', doc_id, '.net/%41) in Springfield, IL 62704 or New York, NY and ', "
    "lang, ' 10', 100 + doc_id % 900, ' end')"
)
PLANTED_DOCS = f"(SELECT doc_id, {PLANTED} AS text FROM documents)"


def planted(spark, d):
    return docs(spark, d).withColumn("text", F.expr(PLANTED))


@query("text_urls_planted", f"SELECT DISTINCT doc_id, unnest({S.all_of('text', K.TEXT_URL)}) AS value FROM {PLANTED_DOCS}")
def text_urls_planted(spark, d):
    return C.entities_long(planted(spark, d), ["urls"]).select("doc_id", "value")


@query("locations_planted", f"SELECT DISTINCT doc_id, unnest({PLACES}) AS value FROM {PLANTED_DOCS}")
def locations_planted(spark, d):
    return C.entities_long(planted(spark, d), ["locations"]).select("doc_id", "value")


@query("word_search_indexed", f"""SELECT doc_id, len(h) AS hits FROM (SELECT doc_id, list_filter({S.all_of('lower(text)', K.TOKEN)}, lambda t: t IN ('the', 'with', 'and')) AS h FROM documents)
WHERE len(list_distinct(h)) = 3""")
def word_search_indexed(spark, d):
    path = fresh_path(spark, "word-index")
    WX.build_index(docs(spark, d), path)
    return WX.search(spark, path, ["the", "With", "and"])


@query("phrase_search", f"""WITH t AS (SELECT doc_id, {S.all_of('lower(text)', K.TOKEN)} AS w FROM documents),
h AS (SELECT doc_id, len([i for i in range(1, len(w)) if w[i] = 'the' AND w[i + 1] = 'of']) AS hits FROM t) SELECT doc_id, hits FROM h WHERE hits > 0""")
def phrase_search(spark, d):
    path = fresh_path(spark, "word-index")
    WX.build_index(docs(spark, d), path)
    return WX.phrase_search(spark, path, ["the", "of"])

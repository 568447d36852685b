"""Page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import html as H
from crawlweave.operators import page_jobs as P
from crawlweave.operators import page_tree as T
from crawlweave.operators import search as SR
from crawlweave.operators import vector_index as VX
from crawlweave.operators.strategies import extract
from crawlweave.plans import sqltext as S
from crawlweave.plans import views as V
from crawlweave.plans.registry import query, table
from crawlweave.session import fresh_path


@query("page_title", f"SELECT page_id, {S.page_title('html')} AS title FROM pages")
def page_title(spark, d):
    return P.extract_pages(table(spark, d, "pages")).select("page_id", "title")


@query("page_text", f"SELECT page_id, {S.page_text('html')} AS text FROM pages")
def page_text(spark, d):
    return P.extract_pages(table(spark, d, "pages")).select("page_id", "text")


@query("page_dataset", f"""WITH {S.LINKS_SQL},
n AS (SELECT page_id, count(*) AS n_links FROM links GROUP BY page_id),
t AS (SELECT page_id, {S.page_title('html')} AS title, {S.page_text('html')} AS text, html FROM pages)
SELECT t.page_id, title, md5(text) AS text_md5, coalesce(n_links, 0) AS n_links, 0 AS n_images, 200 AS status_code, FALSE AS http_error,
  'html' AS data_type, length(html) AS html_length
FROM t LEFT JOIN n ON t.page_id = n.page_id""")
def page_dataset(spark, d):
    return P.extract_pages(table(spark, d, "pages")).select(
        "page_id", "title", F.md5("text").alias("text_md5"), F.size("links").alias("n_links"), F.size("images").alias("n_images"),
        "status_code", "http_error", "data_type", "html_length")


@query("page_headings", f"""SELECT page_id, 'h1' AS level, position, heading FROM (
  SELECT page_id, unnest(range(len(hs))) AS position, unnest(hs) AS heading FROM (
    SELECT page_id, list_transform({S.all_of(S.sub('html', S.HIDDEN), '(?is)<h1(?:' + chr(92) + 's[^>]*)?>(.*?)</h1' + chr(92) + 's*>', 1)},
       lambda h: {S.page_text('h')}) AS hs FROM pages))""")
def page_headings(spark, d):
    return P.headings_long(table(spark, d, "pages"))


@query("page_headings_fixed", f"""SELECT page_id, len(hs) AS n_h1, array_to_string(hs, '|') AS h1, 3 AS levels FROM (
  SELECT page_id, list_transform({S.all_of(S.sub('html', S.HIDDEN), '(?is)<h1(?:' + chr(92) + 's[^>]*)?>(.*?)</h1' + chr(92) + 's*>', 1)}, lambda h: {S.page_text('h')}) AS hs FROM pages)""")
def page_headings_fixed(spark, d):
    """The levels h1 to h3, there even where a page has none."""
    p = table(spark, d, "pages").withColumn("live", H.live_markup(F.col("html"))).withColumn("m", H.heading_map_fixed(F.col("live")))
    return p.select("page_id", F.size(F.col("m")["h1"]).alias("n_h1"), F.array_join(F.col("m")["h1"], "|").alias("h1"), F.size("m").alias("levels"))


@query("page_stats", f"""WITH {S.LINKS_SQL},
n AS (SELECT page_id, count(*) AS n_links FROM links GROUP BY page_id)
SELECT p.page_id, length({S.page_title('html')}) AS title_length, length({S.page_text('html')}) AS content_length,
  length(html) AS html_length, coalesce(n_links, 0) AS links_count, 0 AS images_count
FROM pages p LEFT JOIN n ON p.page_id = n.page_id""")
def page_stats(spark, d):
    return P.page_stats(P.extract_pages(table(spark, d, "pages"))).drop("url")


@query("page_language", f"""SELECT language, count(*) AS n FROM (SELECT CASE WHEN length(t) < 100 THEN 'unknown'
  WHEN regexp_matches(t, '[αβγδεζηθικλμνξοπρστυφχψω]') THEN 'el'
  WHEN regexp_matches(t, '[àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]') THEN 'fr'
  WHEN regexp_matches(t, '[äöüß]') THEN 'de' ELSE 'en' END AS language
  FROM (SELECT {S.page_text('html')} AS t FROM pages)) GROUP BY 1""")
def page_language(spark, d):
    return P.extract_pages(table(spark, d, "pages")).groupBy("language").agg(F.count("*").alias("n"))


@query("page_html_lang", r"""SELECT lower(regexp_extract(html, '(?i)<html\b[^>]*lang="([^"]*)"', 1)) AS language, count(*) AS n FROM pages GROUP BY 1""")
def page_html_lang(spark, d):
    return P.extract_pages(table(spark, d, "pages"), prefer_html_lang=True).groupBy("language").agg(F.count("*").alias("n"))


@query("page_error_rows", """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END AS status_code,
  page_id % 4 IN (1, 2) AS http_error, CASE page_id % 4 WHEN 1 THEN 'HTTP status 404' WHEN 2 THEN 'HTTP status 503' END AS error FROM pages""")
def page_error_rows(spark, d):
    m = F.col("page_id") % 4
    p = table(spark, d, "pages").withColumn("status_code", F.when(m == 1, 404).when(m == 2, 503).otherwise(200))
    return P.extract_pages(p).select("page_id", "status_code", "http_error", "error")


@query("text_page", f"""SELECT doc_id AS page_id, 'Text Content from files.example.com' AS title, md5({S.clean_text('text')}) AS text_md5,
  'text' AS data_type FROM documents""")
def text_page(spark, d):
    p = table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://files.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("html"), F.lit("text/plain").alias("content_type"))
    return P.extract_pages(p).select("page_id", "title", F.md5("text").alias("text_md5"), "data_type")


@query("json_page", """SELECT event_id AS page_id, CASE WHEN event_id % 10 = 0 THEN 'Text Content from api.example.com'
  ELSE 'JSON Data from api.example.com' END AS title, CASE WHEN event_id % 10 = 0 THEN 'text' ELSE 'json' END AS data_type,
  CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_page(spark, d):
    body = F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("}{"))).otherwise(F.col("props"))
    p = table(spark, d, "events").select(
        F.col("event_id").alias("page_id"), F.lit("https://api.example.com/x").alias("url"), body.alias("html"),
        F.lit("application/json; charset=utf-8").alias("content_type"))
    return P.extract_pages(p).select(
        "page_id", "title", "data_type",
        F.when(F.col("data_type") == "json", F.get_json_object("text", "$.k").cast("long")).alias("k"))


SITE = "'https://site' || CAST(doc_id % 50 AS VARCHAR) || '.example.org'"
SID = "CAST(doc_id AS VARCHAR)"


@query("page_images", f"""SELECT doc_id AS page_id, {SITE} || '/img/' || {SID} || '.png' AS image FROM documents
UNION ALL SELECT doc_id, 'https://cdn.example.com/a.png' FROM documents""")
def page_images(spark, d):
    return P.extract_pages(V.rich_pages(spark, d)).select("page_id", F.explode("images").alias("image"))


@query("page_relative_links", f"""SELECT doc_id AS page_id, {SITE} || '/a/up/' || {SID} AS link FROM documents
UNION ALL SELECT doc_id, {SITE} || '/a/b/' || {SID} || '?p=2' FROM documents
UNION ALL SELECT doc_id, {SITE} || '/a/b/' || {SID} || '#top' FROM documents""")
def page_relative_links(spark, d):
    return P.extract_pages(V.rich_pages(spark, d)).select("page_id", F.explode("links").alias("link"))


@query("page_metadata", f"""SELECT doc_id AS page_id, 'About ' || source AS meta_description, lang || '|' || source AS meta_keywords,
  'Og ' || {SID} AS og_title, 'article' AS og_type, 'card-' || lang AS twitter_card, 'M' || {SID} AS ld_name, {SID} AS ld_id,
  'Article' AS ld_type, 5 AS n_meta FROM documents""")
def page_metadata(spark, d):
    m = P.page_metadata(V.rich_pages(spark, d))
    return m.select(
        "page_id", "meta_description", F.array_join("meta_keywords", "|").alias("meta_keywords"),
        F.col("open_graph.title").alias("og_title"), F.col("open_graph.type").alias("og_type"),
        F.col("twitter_cards.card").alias("twitter_card"), F.col("schema_org")["name"].alias("ld_name"),
        F.col("schema_org")["id"].alias("ld_id"), F.col("schema_org")["@type"].alias("ld_type"),
        F.size("meta_tags").alias("n_meta"))


@query("page_heading_levels", f"""SELECT doc_id AS page_id, 'h1' AS level, 0 AS position, 'Head ' || {SID} AS heading FROM documents
UNION ALL SELECT doc_id, 'h2', 0, 'Sub & ' || lang FROM documents""")
def page_heading_levels(spark, d):
    return P.headings_long(V.rich_pages(spark, d))


@query("page_lists", f"""SELECT doc_id AS page_id, 0 AS list_no, 'ul' AS list_type, 0 AS item_no, 'one ' || {SID} AS item FROM documents
UNION ALL SELECT doc_id, 0, 'ul', 1, 'twodeep' FROM documents UNION ALL SELECT doc_id, 0, 'ul', 2, 'deep' FROM documents
UNION ALL SELECT doc_id, 1, 'ol', 0, 'deep' FROM documents""")
def page_lists(spark, d):
    return T.lists_long(T.page_trees(V.rich_pages(spark, d), ["lists"]))


@query("page_tables", """SELECT doc_id AS page_id, 0 AS table_no, r AS row_no, c AS col_no,
  CASE WHEN r = 0 AND c = 0 THEN 'key' WHEN r = 0 THEN 'value' WHEN c = 0 THEN 'source' ELSE source END AS cell
FROM documents, (VALUES (0), (1)) rr(r), (VALUES (0), (1)) cc(c)""")
def page_tables(spark, d):
    return T.tables_long(T.page_trees(V.rich_pages(spark, d), ["tables"]))


@query("page_forms", """SELECT doc_id AS page_id, form_no, action, method, field_no, field_type, field_name FROM documents, (VALUES
  (0, '/send', 'post', 0, 'text', 'q'), (0, '/send', 'post', 1, 'select', 's'), (0, '/send', 'post', 2, 'textarea', 't'),
  (1, '', 'get', 0, 'input', '')) f(form_no, action, method, field_no, field_type, field_name)""")
def page_forms(spark, d):
    return T.forms_long(T.page_trees(V.rich_pages(spark, d), ["forms"]))


@query("field_dataset", f"""SELECT doc_id AS page_id, 'Head ' || {SID} AS heading, doc_id + 0.5 AS price, 3 AS n_items,
  CAST(NULL AS BOOLEAN) AS in_stock FROM documents""")
def field_dataset(spark, d):
    fields = [
        {"name": "heading", "selector": "h1", "type": "text"},
        {"name": "price", "selector": "span#price", "type": "number"},
        {"name": "items", "selector": "li", "type": "array"},
        {"name": "in_stock", "selector": "p.lead", "type": "boolean"},
    ]
    out = T.field_dataset(V.rich_pages(spark, d), fields)
    return out.select("page_id", "heading", "price", F.size("items").alias("n_items"), "in_stock")


@query("structured_bundle", """SELECT doc_id AS page_id, 2 AS n_lists, 1 AS n_tables, 2 AS n_forms, 2 AS n_og, 1 AS n_twitter, 3 AS n_schema FROM documents""")
def structured_bundle(spark, d):
    pages = V.rich_pages(spark, d)
    trees = T.page_trees(pages, ["lists", "tables", "forms"]).select("page_id", F.size("lists").alias("n_lists"), F.size("tables").alias("n_tables"), F.size("forms").alias("n_forms"))
    meta = P.page_metadata(pages).select("page_id", F.size("open_graph").alias("n_og"), F.size("twitter_cards").alias("n_twitter"), F.size("schema_org").alias("n_schema"))
    return trees.join(meta, "page_id")


@query("page_markdown")
def page_markdown(spark, d):
    return T.page_trees(table(spark, d, "pages"), ["markdown"]).select("page_id", "markdown")


PLAIN = r"trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query("rich_markdown", f"""SELECT doc_id AS page_id, '# Head ' || {SID} || E'\n\n## Sub & ' || lang || CASE WHEN {PLAIN} = '' THEN '' ELSE E'\n\n' || {PLAIN} END
  || E'\n\n- one ' || {SID} || E'\n\n- two\n\n- deep' AS markdown FROM documents""")
def rich_markdown(spark, d):
    return T.page_trees(V.rich_pages(spark, d), ["markdown"]).select("page_id", "markdown")


@query("rich_title", f"SELECT doc_id AS page_id, 'Page ' || {SID} AS title FROM documents")
def rich_title(spark, d):
    return P.extract_pages(V.rich_pages(spark, d)).select("page_id", "title")


@query("page_references", f"SELECT doc_id AS page_id, md5({S.clean_text('text')}) AS text_md5 FROM documents")
def page_references(spark, d):
    """Whole texts with their signs and accents written as numbers and names read as they were."""
    return P.extract_pages(V.escaped_pages(spark, d)).select("page_id", F.md5("text").alias("text_md5"))


@query("tree_text_agreement", """SELECT count(*) AS n_pages, 0 AS n_different FROM pages""")
def tree_text_agreement(spark, d):
    """Both engines must see the same list items on every page."""
    p = table(spark, d, "pages")
    from crawlweave.functions import html as H
    from crawlweave.functions.text import find_all

    native = p.select("page_id", F.size(find_all(H.live_markup(F.col("html")), r"(?i)<li\b")).alias("a"))
    tree = T.page_trees(p, ["lists"]).select("page_id", F.aggregate("lists", F.lit(0), lambda s, x: s + F.size(x["items"])).alias("b"))
    return native.join(tree, "page_id").groupBy().agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("a") != F.col("b")).alias("n_different"))


@query("ai_result_cleanup", f"""SELECT conv_id, turn, md5({S.clean_text('text')}) AS markdown_md5,
  {S.clean_text("'  ' || role || ' x  '")} AS item, 1 AS n_internal, 0 AS n_external FROM conversations""")
def ai_result_cleanup(spark, d):
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("markdown"),
        F.array(F.concat(F.lit("  "), "role", F.lit("\t\n x  "))).alias("extracted_content"),
        F.struct(F.array(F.lit("https://a.example.com/x"), F.lit("nope")).alias("internal"),
                 F.lit(None).cast("array<string>").alias("external")).alias("links"))
    return P.clean_ai_results(c).select(
        "conv_id", "turn", F.md5("markdown").alias("markdown_md5"), F.get("extracted_content", F.lit(0)).alias("item"),
        F.size("links.internal").alias("n_internal"), F.size("links.external").alias("n_external"))


@query("semantic_topk", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))
   / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))) AS distance
   FROM embeddings, q)
SELECT vec_id, label, round(distance, 6) AS distance FROM s ORDER BY s.distance, vec_id LIMIT 10""")
def semantic_topk(spark, d):
    e = table(spark, d, "embeddings")
    out = SR.nearest_vectors(e, e.filter("vec_id = 0"), k=10)
    return out.select("vec_id", "label", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query("semantic_topk_indexed", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
   / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS distance
   FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, round(distance, 6) + 0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS rank FROM s) WHERE rank <= 5""")
def semantic_topk_indexed(spark, d):
    """The five nearest of every twentieth vector, through the index, exact."""
    path = fresh_path(spark, "vector-index")
    e = table(spark, d, "embeddings")
    VX.build_index(e, path)
    found = VX.search(spark, path, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


BLOCKS = f"""
blocks AS (SELECT page_id, block_no, block FROM (
  SELECT page_id, unnest(range(len(bs))) AS block_no, unnest(bs) AS block FROM (
    SELECT page_id, list_transform(string_split(regexp_replace({S.sub('html', S.HIDDEN)}, {S.q(SR.BLOCK_TAGS)}, chr(1), 'g'), chr(1)),
      lambda b: {S.page_text('b')}) AS bs FROM pages))
  WHERE len({S.word_list('block')}) >= 10)"""


@query("page_blocks", f"WITH {BLOCKS} SELECT page_id, block_no, md5(block) AS block_md5 FROM blocks")
def page_blocks(spark, d):
    return SR.page_blocks(table(spark, d, "pages")).select("page_id", "block_no", F.md5("block").alias("block_md5"))


PASSAGES = f"""WITH {BLOCKS},
terms AS (SELECT page_id, block_no, term, count(*) AS tf FROM (
  SELECT page_id, block_no, unnest({S.all_of('lower(block)', S.K.TOKEN)}) AS term FROM blocks) GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
n AS (SELECT count(DISTINCT (page_id, block_no)) AS n_blocks FROM terms),
qt AS (SELECT unnest(['the', 'and', 'of']) AS term),
qw AS (SELECT qt.term, ln((n_blocks + 1) / (coalesce(df, 0) + 1)) + 1 AS w FROM qt LEFT JOIN spread s ON s.term = qt.term, n),
sc AS (SELECT page_id, block_no, sum(tf * (ln((n_blocks + 1) / (df + 1)) + 1) * coalesce(qw.w, 0)) AS dot,
         sqrt(sum((tf * (ln((n_blocks + 1) / (df + 1)) + 1)) ^ 2)) AS norm
       FROM terms JOIN spread USING (term) LEFT JOIN qw USING (term), n GROUP BY ALL)
"""


@query("passage_search", PASSAGES + """SELECT page_id, block_no, round(1 - dot / (norm * (SELECT sqrt(sum(w * w)) FROM qw)), 6) AS distance
FROM sc WHERE dot > 0 ORDER BY round(1 - dot / (norm * (SELECT sqrt(sum(w * w)) FROM qw)), 9), page_id, block_no LIMIT 10""")
def passage_search(spark, d):
    blocks = SR.page_blocks(table(spark, d, "pages"))
    out = SR.passage_search(blocks, "the and of", k=10, max_dist=2.0)
    return out.select("page_id", "block_no", F.round("distance", 6).alias("distance"))


@query("strategy_cosine", PASSAGES + """SELECT page_id, block_no, rank FROM (
  SELECT page_id, block_no, row_number() OVER (PARTITION BY page_id ORDER BY round(1 - dot / (norm * (SELECT sqrt(sum(w * w)) FROM qw)), 9), block_no) AS rank FROM sc WHERE dot > 0) WHERE rank <= 3""")
def strategy_cosine(spark, d):
    cfg = {"extraction_strategy": "cosine", "semantic_filter": "the and of", "max_dist": 2.0}
    return extract(table(spark, d, "pages"), cfg).select("page_id", "block_no", "rank")

"""Pages table to structured rows with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import html as H
from crawlweave.functions import text as X
from crawlweave.functions import urls as U


def _json_text(c: Column) -> Column:
    return F.to_json(X.parse_json(c), {"pretty": "true"})


def extract_pages(
    pages: DataFrame, browser: bool = False, prefer_html_lang: bool = False
) -> DataFrame:
    """url, body (``html``), optional content_type and status_code to one structured row per page.

    HTML, JSON and other content take their own branch; bad JSON falls back to text. Pages
    answered with a status of 400 or more keep their content and carry an error.
    """
    cols = set(pages.columns)
    kind = F.lower(F.col("content_type")) if "content_type" in cols else F.lit("text/html")
    status = F.col("status_code") if "status_code" in cols else F.lit(200)
    body, url = F.col("html"), F.col("url")
    keep = [c for c in ("page_id", "job_id", "task_id") if c in cols]

    is_html = F.contains(kind, F.lit("text/html"))
    is_json = F.contains(kind, F.lit("application/json")) & X.parse_json(body).isNotNull()
    netloc = U.part(url, 2)
    empty = F.array().cast("array<string>")

    live = F.col("_live")
    base = pages.withColumn("_live", H.live_markup(body)).select(
        *keep,
        "url",
        status.alias("status_code"),
        F.when(is_html, "html").when(is_json, "json").otherwise("text").alias("data_type"),
        F.when(is_html, H.title(live))
        .when(is_json, F.concat(F.lit("JSON Data from "), netloc))
        .otherwise(F.concat(F.lit("Text Content from "), netloc))
        .alias("title"),
        F.when(is_html, H.visible_text(body, browser))
        .when(is_json, _json_text(body))
        .otherwise(X.clean_text(body))
        .alias("text"),
        F.when(is_html, H.links(live, url)).otherwise(empty).alias("links"),
        F.when(is_html, H.images(live, url)).otherwise(empty).alias("images"),
        F.when(is_html, H.heading_map(live)).alias("headings"),
        F.when(is_html, H.meta_entries(live)).alias("_meta"),
        F.when(is_html & F.lit(prefer_html_lang), H.html_lang(body)).alias("_lang"),
        F.length(body).alias("html_length"),
        (status >= 400).alias("http_error"),
        F.when(status >= 400, F.concat(F.lit("HTTP status "), status.cast("string"))).alias("error"),
    )
    return base.select(
        "*",
        H.meta_description(F.col("_meta")).alias("meta_description"),
        H.meta_keywords(F.col("_meta")).alias("meta_keywords"),
        X.emails(F.col("text")).alias("emails"),
        X.phones_multi(F.col("text")).alias("phone_numbers"),
        F.coalesce(F.nullif(F.col("_lang"), F.lit("")), X.language_by_letters(F.col("text"))).alias("language"),
    ).drop("_meta", "_lang")


def page_stats(extracted: DataFrame) -> DataFrame:
    keep = [c for c in ("page_id",) if c in extracted.columns]
    return extracted.select(
        *keep,
        "url",
        F.length("title").alias("title_length"),
        F.length("text").alias("content_length"),
        "html_length",
        F.size("links").alias("links_count"),
        F.size("images").alias("images_count"),
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """Meta maps and JSON-LD of every page."""
    body = F.col("html")
    return (
        pages.select("page_id", "url", H.meta_entries(H.live_markup(body)).alias("_meta"), H.json_ld(body).alias("schema_org"))
        .select(
            "page_id",
            "url",
            H.meta_description(F.col("_meta")).alias("meta_description"),
            H.meta_keywords(F.col("_meta")).alias("meta_keywords"),
            H.meta_map(F.col("_meta")).alias("meta_tags"),
            H.prefixed_map(F.col("_meta"), "property", "og:").alias("open_graph"),
            H.prefixed_map(F.col("_meta"), "name", "twitter:").alias("twitter_cards"),
            "schema_org",
        )
    )


def headings_long(pages: DataFrame) -> DataFrame:
    """(page_id, level, position, heading)."""
    return pages.select(
        "page_id", F.explode(H.heading_map(H.live_markup(F.col("html")))).alias("level", "_texts")
    ).select("page_id", "level", F.posexplode("_texts").alias("position", "heading"))


def clean_ai_results(results: DataFrame) -> DataFrame:
    """markdown, extracted_content (text, list or map columns) cleaned; unusable links dropped.

    ``links`` is a struct of two arrays; missing lists become empty.
    """
    empty = F.array().cast("array<string>")

    def good(side: str) -> Column:
        return F.coalesce(F.filter(F.col(f"links.{side}"), U.is_valid_url), empty)

    out = results.withColumn(
        "markdown", F.when(F.col("markdown").isNotNull(), X.clean_text(F.col("markdown")))
    ).withColumn("links", F.struct(good("internal").alias("internal"), good("external").alias("external")))
    for f in results.schema.fields:
        if not f.name.startswith("extracted"):
            continue
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind == "string":
            out = out.withColumn(f.name, F.when(c.isNotNull(), X.clean_text(c)))
        elif kind == "array<string>":
            out = out.withColumn(f.name, F.transform(c, lambda x: X.clean_text(x)))
        elif kind == "map<string,string>":
            out = out.withColumn(f.name, F.transform_values(c, lambda _, v: X.clean_text(v)))
    return out

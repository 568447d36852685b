"""Classification and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions.urls import is_valid_url


INDICATORS = {"product": K.PRODUCT_WORDS, "contact": K.CONTACT_WORDS, "news": K.NEWS_WORDS}


def indicator_hits(low: Column, kind: str) -> Column:
    """How many of the words of a content type occur in the lower-cased text."""
    total = F.lit(0)
    for w in INDICATORS[kind]:
        total = total + F.contains(low, F.lit(w)).cast("int")
    return total


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def content_type(product: Column, contact: Column, news: Column) -> Column:
    """(content_type, three flags, is_blog_post, confidence_score) as a struct, from the hits per type."""
    top = F.greatest(product, contact, news)
    kind = (
        F.when(top == 0, "article")
        .when(product == top, "product")
        .when(contact == top, "contact")
        .otherwise("news")
    )
    return F.struct(
        kind.alias("content_type"),
        (kind == "product").alias("is_product_page"),
        (kind == "contact").alias("is_contact_page"),
        (kind == "news").alias("is_news_article"),
        F.lit(False).alias("is_blog_post"),
        F.least(top / 10, F.lit(1.0)).alias("confidence_score"),
    )


def quality_metrics(
    raw_chars: Column, clean_chars: Column, words: Column, entity_sizes: Column, n_links: Column
) -> Column:
    """Five metrics from lengths, word count, a map kind->size and the link count."""
    sizes = F.map_values(entity_sizes)
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    filled = F.size(F.filter(sizes, lambda x: x > 0))
    contact = (entity_sizes["emails"] > 0) | (entity_sizes["phone_numbers"] > 0)
    overall = (
        F.least(words / 100, F.lit(1.0))
        + F.least(entity_sizes["keywords"] / 10, F.lit(1.0))
        + F.when(contact, 1.0).otherwise(0.0)
        + F.least(F.coalesce(n_links, F.lit(0)) / 5, F.lit(1.0))
    ) / 4
    return F.struct(
        F.when(raw_chars > 0, clean_chars / raw_chars).otherwise(0.0).alias("content_retention"),
        (total / F.greatest(words, F.lit(1))).alias("information_density"),
        overall.alias("overall_quality"),
        (filled / F.size(sizes)).alias("entity_richness"),
        (F.greatest(F.lit(0.0), overall - 0.5) * 2).alias("processing_improvement"),
    )


def data_quality(url: Column, title: Column, content: Column) -> Column:
    has_url, has_title, has_content = _present(url), _present(title), _present(content)
    score = (
        F.when(has_url & is_valid_url(url), 0.2).otherwise(0.0)
        + F.when(has_title & (F.length(title) > 10), 0.3).otherwise(0.0)
        + F.when(has_content & (F.length(content) > 100), 0.5).otherwise(0.0)
    )
    present = has_url.cast("int") + has_title.cast("int") + has_content.cast("int")
    return F.struct(
        F.least(score, F.lit(1.0)).alias("quality_score"),
        (present / 3).alias("completeness_score"),
        present.alias("present_fields"),
        F.lit(3).alias("total_fields"),
    )


def page_score(success: Column, title: Column, content: Column, n_links: Column, status: Column) -> Column:
    tl, cl, nl = F.length(title), F.length(content), F.coalesce(n_links, F.lit(0))
    points = (
        F.when(~_present(title), 0).when((tl >= 10) & (tl <= 100), 20).when(tl > 100, 15).otherwise(10)
        + F.when(~_present(content), 0).when(cl > 1000, 40).when(cl > 500, 30).when(cl > 100, 20).otherwise(10)
        + F.when(nl > 10, 20).when(nl > 5, 15).when(nl > 0, 10).otherwise(0)
        + F.when(status == 200, 20)
        .when((status >= 200) & (status < 300), 15)
        .when((status >= 300) & (status < 400), 10)
        .otherwise(0)
    )
    return F.when(success, F.least(points / 100, F.lit(1.0))).otherwise(0.0)


def ai_score(success: Column, markdown: Column, extracted: Column, n_links: Column, n_images: Column) -> Column:
    """``extracted`` is a boolean: did the strategy return anything."""
    size = F.length(markdown)
    nl, ni = F.coalesce(n_links, F.lit(0)), F.coalesce(n_images, F.lit(0))
    score = (
        F.lit(0.3)
        + F.when(size > 1000, 0.25).when(size > 500, 0.15).when(size > 100, 0.05).otherwise(0.0)
        + F.when(extracted, 0.2).otherwise(0.0)
        + F.least(F.lit(0.15), nl * 0.02)
        + F.least(F.lit(0.1), ni * 0.01)
    )
    return F.when(success & _present(markdown), F.least(F.lit(1.0), score)).otherwise(0.0)


def tier(score: Column, high: float = 0.77, medium: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")

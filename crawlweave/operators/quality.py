"""Whole-record processing and the reports built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import scores as S
from crawlweave.functions import text as X
from crawlweave.functions import urls as U
from crawlweave.functions.fixed import ENTITY_LIMIT
from crawlweave.operators.skew import join_lookup

KIND_KEYS = tuple(X.ENTITY_KINDS)


def _entity_sizes(body: Column) -> Column:
    """Sizes per kind as ``entities`` shows them; keywords are counted without being ranked."""
    args: list[Column] = []
    for kind, fn in X.ENTITY_KINDS.items():
        size = X.keyword_count(body) if kind == "keywords" else F.size(fn(body))
        args += [F.lit(kind), F.least(size, F.lit(ENTITY_LIMIT)) if kind in X.LIMITED_KINDS else size]
    return F.create_map(*args)


def with_quality(
    records: DataFrame, source: str = "cleaned", content: str = "content", keep_entities: bool = False
) -> DataFrame:
    """Adds clean_content, entity_sizes, quality and content_analysis; nothing is shuffled.

    Needs ``content`` and ``links``. Entities come from the cleaned text unless
    ``source='raw'``; their values are only built with ``keep_entities``.
    """
    return _scored(records, source, content, keep_entities).drop("_flat")


def _scored(records: DataFrame, source: str, content: str, keep_entities: bool) -> DataFrame:
    """``with_quality`` and the text with its whitespace collapsed as ``_flat``."""
    raw = F.coalesce(F.col(content), F.lit(""))
    body = F.col("clean_content") if source == "cleaned" else raw
    out = records.withColumn("_flat", X.collapse_ws(raw)).withColumn("clean_content", X.clean_flat(F.col("_flat")))
    if keep_entities:
        out = out.withColumn("extracted_entities", X.entities(body))
    sizes = F.transform_values("extracted_entities", lambda _, v: F.size(v)) if keep_entities else _entity_sizes(body)
    # values used more than once are columns of their own: Spark then computes them once
    return (
        classify_text(out, "clean_content")
        .withColumns({"entity_sizes": sizes, "_words": X.flat_word_count(F.col("clean_content"))})
        .withColumn(
            "quality",
            S.quality_metrics(
                F.length(raw), F.length("clean_content"), F.col("_words"), F.col("entity_sizes"), F.size("links")
            ),
        )
        .drop("_words")
    )


def classify_text(df: DataFrame, text: str) -> DataFrame:
    """Adds content_analysis."""
    return (
        df.withColumn("_low", F.lower(text))
        .withColumns({f"_{k}": S.indicator_hits(F.col("_low"), k) for k in S.INDICATORS})
        .withColumn("content_analysis", S.content_type(*[F.col(f"_{k}") for k in S.INDICATORS]))
        .drop("_low", *[f"_{k}" for k in S.INDICATORS])
    )


def enhancements(url: Column, content: Column, words: Column, sizes: Column, flat: Column | None = None) -> Column:
    """``flat``: the content with its whitespace collapsed, if that is known."""
    return F.struct(
        F.when(
            F.coalesce(url, F.lit("")) != "",
            F.struct(
                U.part(url, 2).alias("domain"),
                U.path_depth(url).alias("path_depth"),
                U.has_query(url).alias("has_query_params"),
                U.is_secure(url).alias("is_secure"),
            ),
        ).alias("url_analysis"),
        F.struct(
            words.alias("word_count"),
            F.length(content).alias("char_count"),
            X.paragraph_count(content).alias("paragraph_count"),
            X.reading_minutes(content, words).alias("reading_time_minutes"),
        ).alias("content_stats"),
        sizes.alias("entity_stats"),
        (X.language_by_words(content) if flat is None else X.flat_language(flat)).alias("language"),
    )


def process_records(records: DataFrame, source: str = "cleaned", as_of: Column | None = None) -> DataFrame:
    """url, title, content, links to processed rows.

    A record without a URL is not an error of the job: it comes out with ``success`` false
    and a message.
    """
    ok = F.col("url").isNotNull()
    raw = F.coalesce(F.col("content"), F.lit(""))
    keep = [c for c in ("page_id", "job_id", "task_id", "doc_id") if c in records.columns]
    out = _scored(records, source, "content", keep_entities=True).withColumn("_raw_words", X.flat_word_count(F.col("_flat")))
    size = F.length(F.to_json(F.struct(*[F.col(c) for c in records.columns])))
    return out.select(
        *keep,
        F.coalesce("url", F.lit("Unknown")).alias("original_url"),
        F.when(ok, X.clean_title(F.col("title"))).otherwise("").alias("cleaned_title"),
        F.when(ok, F.col("clean_content")).otherwise("").alias("cleaned_content"),
        F.when(ok, F.col("extracted_entities")).alias("extracted_entities"),
        F.when(ok, F.col("content_analysis")).alias("content_analysis"),
        F.when(ok, F.col("quality")).alias("quality_metrics"),
        F.when(ok, enhancements(F.col("url"), raw, F.col("_raw_words"), F.col("entity_sizes"), F.col("_flat"))).alias("enhancements"),
        size.alias("original_data_size"),
        F.when(ok, F.length("clean_content")).otherwise(0).alias("processed_data_size"),
        (as_of if as_of is not None else F.lit(None).cast("timestamp")).alias("processing_timestamp"),
        ok.alias("success"),
        F.when(~ok, "Data processing failed: Invalid input data structure").alias("error_message"),
    )


def domain_report(records: DataFrame) -> DataFrame:
    """Pages, average scores, links, copies, top content type and languages per domain.

    Rows are first summed per (domain, text hash), which spreads a domain with a third of
    all pages over many tasks; the domain level then sums those sums. Types are few and
    fixed, so they are counted side by side in the same pass.
    """
    kinds = ("article", "contact", "news", "product")  # by name: ties go to the first
    scored = with_quality(records).select(
        U.domain(F.col("url")).alias("domain"),
        F.col("quality.overall_quality").alias("q"),
        S.data_quality(F.col("url"), F.col("title"), F.col("content"))["quality_score"].alias("d"),
        F.size("links").alias("links"),
        *[(F.col("content_analysis.content_type") == k).cast("int").alias(k) for k in kinds],
        X.content_hash(F.col("content")).alias("hash"),
        X.language_by_letters(F.col("content")).alias("language"),
    )
    sums, languages = ("q", "d", "links", *kinds), [f"_{code}" for code in X.LETTER_LANGUAGES]
    scored = scored.withColumns({f"_{code}": (F.col("language") == code).cast("int") for code in X.LETTER_LANGUAGES})
    per_text = scored.groupBy("domain", "hash").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in languages]
    )
    top = F.greatest(*[F.sum(k) for k in kinds])
    return per_text.groupBy("domain").agg(
        F.sum("n").alias("pages"),
        (F.sum("q") / F.sum("n")).alias("avg_quality"),
        (F.sum("d") / F.sum("n")).alias("avg_data_quality"),
        F.sum("links").alias("links"),
        F.sum(F.col("n") - 1).alias("copies"),
        F.coalesce(*[F.when(F.sum(k) == top, F.lit(k)) for k in kinds]).alias("top_type"),
        F.concat_ws(",", *[F.when(F.max(c) == 1, F.lit(c[1:])) for c in languages]).alias("languages"),
    )


def label_agreement(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Average scores and sizes of documents by their given quality label."""
    labelled = join_lookup(docs, labels, ["doc_id"], "inner")  # before scoring: only labelled texts are scored
    return (
        with_quality(labelled.withColumn("links", F.array().cast("array<string>")), "raw", "text")
        .groupBy("quality_label")
        .agg(
            F.count("*").alias("n_docs"),
            F.avg("quality.overall_quality").alias("avg_quality"),
            F.avg("quality.information_density").alias("avg_density"),
            F.avg("quality.content_retention").alias("avg_retention"),
        )
    )

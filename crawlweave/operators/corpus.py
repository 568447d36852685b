"""Jobs over a documents table (doc_id, text, lang, source)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions import text as X
from crawlweave.operators.ordered import percentiles_of_counts
from crawlweave.operators.skew import join_groups
from crawlweave.session import materialize


def clean_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("clean_text", X.clean_text(F.col(text))).withColumn(
        "clean_content", X.clean_content(F.col(text))
    )


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(content_hash, first_doc, n_docs). Only hash and id are shuffled, partially aggregated first."""
    return _groups(docs.select(X.content_hash(F.col(text)).alias("content_hash"), doc_id), doc_id)


def _groups(hashed: DataFrame, doc_id: str) -> DataFrame:
    return hashed.groupBy("content_hash").agg(F.min(doc_id).alias("first_doc"), F.count("*").alias("n_docs"))


def dedupe_content(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, content_hash, first_doc, n_docs, kept) for every document.

    The texts are read once: ids and hashes are kept as a table, and grouping and joining use that.

    A text copied over much of the corpus is a hot group and takes the broadcast branch
    of ``join_groups``.
    """
    hashed = materialize(docs.select(doc_id, X.content_hash(F.col(text)).alias("content_hash")), "hashes")
    joined = join_groups(hashed, _groups(hashed, doc_id), ["content_hash"], "n_docs")
    return joined.withColumn("kept", F.col(doc_id) == F.col("first_doc"))


def entities_long(
    docs: DataFrame, kinds: Iterable[str] = tuple(X.ENTITY_KINDS), source: str = "raw", text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, kind, value). ``source='cleaned'`` looks at the cleaned text, in which
    the characters of e-mails, URLs and handles no longer exist."""
    body = F.col(text) if source == "raw" else X.clean_content(F.col(text))

    def tagged(kind: str):
        return F.transform(X.ENTITY_KINDS[kind](body), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*[tagged(k) for k in kinds])
    return docs.select(doc_id, F.explode(found).alias("e")).select(doc_id, "e.kind", "e.value")


def value_index(long: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(kind, value, n_docs, first_doc) from ``entities_long`` rows."""
    per_doc = long.groupBy("kind", "value", doc_id).agg(F.count("*").alias("n"))
    return per_doc.groupBy("kind", "value").agg(F.count("*").alias("n_docs"), F.min(doc_id).alias("first_doc"))


def contact_index(docs: DataFrame, source: str = "raw") -> DataFrame:
    return value_index(entities_long(docs, ("emails", "phone_numbers", "urls", "social_handles"), source))


def entity_index(docs: DataFrame, source: str = "raw") -> DataFrame:
    return value_index(entities_long(docs, ("companies", "locations"), source))


def keyword_ranking(docs: DataFrame, by: str, limit: int = K.KEYWORD_LIMIT, text: str = "text") -> DataFrame:
    """(by, word, n, rank): the most frequent keywords of each group.

    Words are counted on the map side first; the rank filter is pushed below the shuffle
    by Spark's window group limit, so a task never ranks more than ``limit`` rows per
    group and map partition.
    """
    counts = (
        docs.select(by, F.explode(X.keyword_tokens(F.col(text))).alias("word"))
        .groupBy(by, "word")
        .agg(F.count("*").alias("n"))
    )
    w = W.partitionBy(by).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def doc_keywords(docs: DataFrame, limit: int = K.KEYWORD_LIMIT) -> DataFrame:
    """(doc_id, rank, word) computed inside each row, no shuffle."""
    return docs.select("doc_id", F.posexplode(X.keywords(F.col("text"), limit)).alias("p", "word")).select(
        "doc_id", (F.col("p") + 1).alias("rank"), "word"
    )


def document_frequency(docs: DataFrame) -> DataFrame:
    """(word, n_docs, n_total) over the corpus; a document counts once per word."""
    words = docs.select("doc_id", F.explode(X.keyword_tokens(F.col("text"))).alias("word"))
    per_doc = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return per_doc.groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_total"))


def language_report(docs: DataFrame) -> DataFrame:
    """Declared against detected language per source."""
    return (
        docs.withColumn("clean_text", X.clean_text(F.col("text")))
        .select(
            "source",
            "lang",
            X.language_by_words(F.col("text")).alias("lang_by_words"),
            X.language_by_letters(F.col("clean_text")).alias("lang_by_letters"),
        )
        .groupBy("source", "lang", "lang_by_words", "lang_by_letters")
        .agg(F.count("*").alias("n_docs"))
    )


def content_stats(docs: DataFrame) -> DataFrame:
    c = F.col("text")
    return docs.withColumn("word_count", X.word_count(c)).select(
        "doc_id",
        "source",
        "word_count",
        F.length(c).alias("char_count"),
        X.paragraph_count(c).alias("paragraph_count"),
        X.reading_minutes(c, F.col("word_count")).alias("reading_time_minutes"),
    )


def corpus_stats(docs: DataFrame, points=(0.5, 0.95)) -> DataFrame:
    """Sums per source with exact word-count percentiles."""
    # one row per (source, word count): all sums and ranks follow from it
    fine = materialize(
        content_stats(docs)
        .groupBy("source", "word_count")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(c) for c in ("char_count", "paragraph_count", "reading_time_minutes")],
        ),
        "word-counts",
    )
    sums = fine.groupBy("source").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.col("word_count") * F.col("n")).alias("words"),
        F.sum("char_count").alias("chars"),
        F.sum("paragraph_count").alias("paragraphs"),
        F.sum("reading_time_minutes").alias("reading_minutes"),
    )
    return sums.join(percentiles_of_counts(fine, ["source"], "word_count", "n", points), "source", "left")

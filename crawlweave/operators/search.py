"""Word search, vector search and passage search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.functions import html as H
from crawlweave.functions import text as X
from crawlweave.operators.skew import join_groups
from crawlweave.session import materialize

BLOCK_TAGS = (
    r"(?is)</?(?:p|h[1-6]|li|ul|ol|div|article|section|nav|header|footer|table|tr|td|th|br|title|body|head|html)"
    r"\b[^>]*>"
)


def token_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(term, doc_id, tf)."""
    return (
        docs.select(doc_id, F.explode(X.tokens(F.col(text))).alias("term"))
        .groupBy(doc_id, "term").agg(F.count("*").alias("tf"))
    )


def word_search(docs: DataFrame, words: Sequence[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents that hold all ``words``, with the number of hits.

    Documents are narrowed by a substring test, then tokenised and filtered inside the
    row; only matching rows move.
    """
    wanted = sorted({w.lower() for w in words})
    low = F.lower(text)
    near = docs
    for w in wanted:
        near = near.filter(F.contains(low, F.lit(w)))
    hits = F.filter(X.tokens(F.col(text)), lambda t: t.isin(*wanted))
    return (
        near.select(doc_id, hits.alias("_h"))
        .filter(F.size(F.array_distinct("_h")) == len(wanted))
        .select(doc_id, F.size("_h").alias("hits"))
    )


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_vectors(vectors: DataFrame, query: DataFrame, k: int = 3, max_dist: float | None = None) -> DataFrame:
    """The ``k`` vectors nearest to the single-row ``query`` (column ``embedding``) by cosine distance."""
    q = query.select("embedding").limit(1).scalar()
    scored = vectors.withColumn("_q", q).withColumn("distance", 1 - cosine(F.col("embedding"), F.col("_q"))).drop("_q")
    if max_dist is not None:
        scored = scored.filter(F.col("distance") <= max_dist)
    return scored.orderBy("distance", "vec_id").limit(k)


def page_blocks(pages: DataFrame, min_words: int = 10) -> DataFrame:
    """(page_id, block_no, block): text between block-level tags, short ones dropped."""
    cut = F.split(F.regexp_replace(H.live_markup(F.col("html")), BLOCK_TAGS, "\u0001"), "\u0001")
    return (
        pages.select("page_id", F.posexplode(F.transform(cut, lambda b: H.visible_text(b))).alias("block_no", "block"))
        .filter(X.word_count(F.col("block")) >= min_words)
    )


def passage_search(
    blocks: DataFrame, query: str, k: int = 3, max_dist: float = 0.2, per_page: bool = False
) -> DataFrame:
    """Blocks nearest to ``query`` by TF-IDF cosine.

    Distances are rounded to nine digits, so that ties do not hang on the order of summation.
    Terms and their counts are kept as a table, since weights, norms and frequencies all
    read them. A word present in most blocks is a hot join key; its
    document frequency is joined by broadcast through ``join_groups``.
    """
    terms = materialize(
        blocks.select("page_id", "block_no", F.explode(X.tokens(F.col("block"))).alias("term"))
        .groupBy("page_id", "block_no", "term").agg(F.count("*").alias("tf")),
        "terms",
    )
    spread = terms.groupBy("term").agg(F.count("*").alias("df"))
    n_blocks = terms.groupBy("page_id", "block_no").agg(F.lit(1).alias("one")).groupBy().agg(F.count("*")).scalar()
    idf = F.log((n_blocks + 1) / (F.col("df") + 1)) + 1
    q = blocks.sparkSession.range(1).select(F.explode(X.tokens(F.lit(query))).alias("term"))
    q = q.groupBy("term").agg(F.count("*").alias("q_tf"))  # as large as the query text
    q_weighted = (
        q.join(spread, "term", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .select("term", (F.col("q_tf") * idf).alias("qw"))
    )
    q_norm = q_weighted.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw")))).scalar()
    weighted = (
        join_groups(terms, spread, ["term"], "df")
        .withColumn("w", F.col("tf") * idf)
        .join(F.broadcast(q_weighted), "term", "left")
    )
    scored = (
        weighted.groupBy("page_id", "block_no")
        .agg(F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"),
             F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        .filter("dot > 0")
        .select("page_id", "block_no", F.round(1 - F.col("dot") / (F.col("norm") * q_norm), 9).alias("distance"))
        .filter(F.col("distance") <= max_dist)
    )
    if per_page:
        w = W.partitionBy("page_id").orderBy("distance", "block_no")
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return scored.orderBy("distance", "page_id", "block_no").limit(k)

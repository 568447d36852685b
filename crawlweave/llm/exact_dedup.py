"""Exact deduplication by content sort, in DataFrame operations only.

Texts are equal when they agree after each run of ``[\\x20\\x09-\\x0D]`` became one space; null counts as
empty. Spark samples splitters over (first 64 characters, digest, salt), range-partitions the rows by
them and sorts each range with its external sorter by (those keys, whole text, id), so that equal texts
are neighbours. The window over that order compares neighbouring rows in full, keeps the row with the
smallest id and counts the run.

Hot groups: a text that holds more than 1 / ``HOT_GROUPS`` of all rows is salted over all ranges. Its
smallest id and size come from one pre-aggregated count per digest; there are at most ``HOT_GROUPS``
such texts, so the table of them is bounded and broadcast.

Defined cases: null text equals empty text. A null id never stays while another row of its group has an
id. Of rows with the same text and the same id, one stays. An empty table gives an empty result. Columns
of the input keep their names and values, whatever they are called; result columns are added behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.llm.columns import packed

SPACES = r"[\x20\x09-\x0D]+"
HOT_GROUPS = 2_000


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, carry: Sequence[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each input row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``carry``: the input columns to return; all by default. Without the text among them, only its
    normal form travels.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(docs.columns if carry is None else carry)
    with_text = text in names
    rows = docs.select(
        packed(docs, carry).alias("_row"), F.col(key).alias("_id"), normal(F.col(text)).alias("_norm")
    ).withColumn("_sha", F.sha2("_norm", 256))

    sizes = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_hot_n"), F.min("_id").alias("_hot_id"))
    hot = sizes.filter(F.col("_hot_n") * HOT_GROUPS > max(docs.count(), HOT_GROUPS))

    keyed = rows.join(F.broadcast(hot), "_sha", "left").withColumns({
        "_head": F.substring("_norm", 1, 64),
        "_salt": F.when(F.col("_hot_n").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(ranges)).cast("int")).otherwise(0),
    })
    if with_text:
        keyed = keyed.drop("_norm")
    placed = keyed.repartitionByRange(ranges, "_head", "_sha", "_salt")
    if with_text:
        placed = placed.withColumn("_norm", normal(F.col(f"_row.`{text}`")))
    run = Window.partitionBy("_head", "_sha", "_salt", "_norm").orderBy(F.col("_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = placed.select(
        "_row", "_id", "_sha", "_hot_n", "_hot_id", F.row_number().over(run).alias("_nth"),
        F.first("_id").over(whole).alias("_first"), F.count(F.lit(1)).over(whole).alias("_n"),
    )
    keep = F.when(F.col("_hot_n").isNotNull(), F.col("_hot_id")).otherwise(F.col("_first"))
    return marked.select(
        "_row.*",
        keep.alias("keep_id"),
        F.coalesce("_hot_n", "_n").alias("group_size"),
        ((F.col("_nth") == 1) & F.col("_id").eqNullSafe(keep)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of the input."""
    n = len(docs.columns)
    found = exact_groups(docs, text=text, key=key)
    plain = found.toDF(*[f"_c{i}" for i in range(n)], "keep_id", "group_size", "kept", "text_sha256")
    return plain.filter("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])

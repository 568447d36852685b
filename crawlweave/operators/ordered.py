"""Order-dependent operators that stay spread out when one key holds most rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task. Here rows
are range-partitioned by key and order together, so a hot key is cut into many chunks;
each chunk is scanned on its own and chunk totals carry the state across the cuts.
Only a key that continues from the chunk before needs a carried value, so there is at
most one carried row per chunk and broadcasting them is bounded by the partition count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.operators.skew import join_groups
from crawlweave.session import cut_lineage

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """Rows tagged with the range chunk they fall in; ``order`` must end in a unique column."""
    cols = [F.col(k) for k in keys] + [F.desc(o) if descending else F.asc(o) for o in order]
    return cut_lineage(df.repartitionByRange(*cols).withColumn(CHUNK, F.spark_partition_id()))


def _in_chunk(keys, order, descending):
    sort = [F.desc(o) if descending else F.asc(o) for o in order]
    return W.partitionBy(*keys, CHUNK).orderBy(*sort)


def _carry(chunks: DataFrame, keys, aggs: list[Column], carried: list[Column]) -> DataFrame:
    """Per (key, chunk) the state left by earlier chunks, only where there is any."""
    earlier = F.row_number().over(W.partitionBy(*keys).orderBy(CHUNK))
    return (
        chunks.groupBy(*keys, CHUNK)
        .agg(*aggs)
        .select(*keys, CHUNK, *carried, earlier.alias("_part"))
        .filter("_part > 1")
        .drop("_part")
    )


def running_sum(
    chunks: DataFrame, keys, order, value: Column, out: str, descending: bool = False
) -> DataFrame:
    """Inclusive running sum of ``value`` per key over a ``chunked`` frame."""
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = _carry(chunks, keys, [F.sum(value).alias("_total")], [F.sum("_total").over(before).alias("_before")])
    local = F.sum(value).over(_in_chunk(keys, order, descending).rowsBetween(W.unboundedPreceding, 0))
    return (
        chunks.withColumn("_local", local)
        .join(F.broadcast(carry), [*keys, CHUNK], "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_local", "_before")
    )


def number_rows(df: DataFrame, keys, order, out: str = "rn", descending: bool = False) -> DataFrame:
    """Exact 1-based row number per key."""
    chunks = chunked(df, keys, order, descending)
    return running_sum(chunks, keys, order, F.lit(1), out, descending).drop(CHUNK)


def previous_value(chunks: DataFrame, keys, order, value: str, out: str) -> DataFrame:
    """``value`` of the row before, per key, across chunk cuts."""
    last = F.max_by(F.col(value), F.struct(*[F.col(o) for o in order])).alias("_last")
    carry = _carry(chunks, keys, [last], [F.lag("_last").over(W.partitionBy(*keys).orderBy(CHUNK)).alias("_edge")])
    w = _in_chunk(keys, order, False)
    return (
        chunks.withColumn("_lag", F.lag(value).over(w))
        .withColumn("_first", F.row_number().over(w) == 1)
        .join(F.broadcast(carry), [*keys, CHUNK], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_lag")))
        .drop("_lag", "_first", "_edge")
    )


def exact_percentiles(df: DataFrame, keys, value: str, points: Sequence[float]) -> DataFrame:
    """Interpolated percentiles per key as columns ``p50``, ``p95``...

    Equal values are counted first, then cumulative counts locate the ranks. Nothing holds
    a whole group's values in one task, unlike the built-in exact ``percentile``.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return percentiles_of_counts(counts, keys, value, "_n", points)


def percentiles_of_counts(counts: DataFrame, keys, value: str, n: str, points: Sequence[float]) -> DataFrame:
    """The same from rows (keys, value, n), one per distinct value."""
    chunks = chunked(counts.select(*keys, value, F.col(n).alias("_n")), keys, [value])
    cum = running_sum(chunks, keys, [value], F.col("_n"), "_hi")
    totals = chunks.groupBy(*keys).agg(F.sum("_n").alias("_rows"))
    ranks = totals.select(
        *keys,
        "_rows",
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("p"), (F.col("_rows") - 1).alias("last")) for p in points])
        ).alias("_r"),
    ).select(*keys, "_rows", F.col("_r.p").alias("_p"), (F.col("_r.p") * F.col("_r.last")).alias("_pos"))
    # a key has one rank row per point: gather them into one row so the join stays one-to-many
    wanted = ranks.groupBy(*keys).agg(
        F.collect_list(F.struct("_p", "_pos")).alias("_want"), F.max("_rows").alias("_rows")
    )
    hits = (
        join_groups(cum, wanted, keys, "_rows")
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn(
            "_want",
            F.filter(
                "_want",
                lambda w: (F.ceil(w["_pos"]) >= F.col("_lo")) & (F.floor(w["_pos"]) < F.col("_hi")),
            ),
        )
        .select(*keys, value, "_lo", "_hi", F.explode("_want").alias("_w"))
    )
    pos, low = F.col("_w._pos"), F.floor(F.col("_w._pos"))
    share = pos - low
    at_low = F.when((low >= F.col("_lo")) & (low < F.col("_hi")), F.col(value) * (1 - share))
    up = F.ceil(pos)
    at_up = F.when((up >= F.col("_lo")) & (up < F.col("_hi")), F.col(value) * share)
    per_point = hits.groupBy(*keys, F.col("_w._p").alias("_p")).agg(
        (F.coalesce(F.sum(at_low), F.lit(0.0)) + F.coalesce(F.sum(at_up), F.lit(0.0))).alias("_v")
    )
    return per_point.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{round(p * 100)}") for p in points]
    )

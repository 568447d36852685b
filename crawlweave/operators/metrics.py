"""Counters, histograms, percentiles and rates over event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.operators.ordered import exact_percentiles


def counters(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(
    df: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = K.DURATION_BUCKETS
) -> DataFrame:
    """(labels, le, cumulative, count, sum) with a last bound of infinity.

    A row finds its bucket once; cumulating touches bucket counts only, not rows times buckets.
    """
    v = F.col(value)
    slot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        slot = F.when(v <= bounds[i], i).otherwise(slot)
    per_slot = (
        df.filter(v.isNotNull())
        .groupBy(*labels, slot.alias("slot"))
        .agg(F.count("*").alias("n"), F.sum(v).alias("s"))
    )
    wide = per_slot.groupBy(*labels).agg(
        F.sum("n").alias("count"),
        F.sum("s").alias("sum"),
        *[
            F.coalesce(F.sum(F.when(F.col("slot") <= i, F.col("n"))), F.lit(0)).alias(f"_b{i}")
            for i in range(len(bounds) + 1)
        ],
    )
    les = [*bounds, float("inf")]
    rows = F.array(
        *[F.struct(F.lit(float(le)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, le in enumerate(les)]
    )
    return wide.select(*labels, "count", "sum", F.explode(rows).alias("r")).select(
        *labels, "r.le", "r.cumulative", "count", "sum"
    )


def percentiles(
    df: DataFrame, labels: Sequence[str], value: str, points: Sequence[float] = (0.5, 0.95, 0.99), exact: bool = True
) -> DataFrame:
    """Interpolated percentiles, or a mergeable approximation when ``exact`` is false."""
    if exact:
        return exact_percentiles(df, labels, value, points)
    return df.groupBy(*labels).agg(
        *[F.percentile_approx(value, p, 10_000).alias(f"p{round(p * 100)}") for p in points]
    )


SKETCH_K = 1_000
RANK_ERROR = 0.01  # of a sketch with SKETCH_K, whatever the number of values


def percentile_sketches(df: DataFrame, ts: str, labels: Sequence[str], value: str, every: str = "hour") -> DataFrame:
    """(labels, period, n, sketch): one mergeable quantile sketch for each label and period, to be stored and rolled up later."""
    return df.filter(F.col(value).isNotNull()).groupBy(*labels, F.date_trunc(every, ts).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch")
    )


def percentiles_of_sketches(
    sketches: DataFrame, labels: Sequence[str], points: Sequence[float] = (0.5, 0.95, 0.99), start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Percentiles of all values from ``start`` up to ``end``, from stored sketches alone, each within ``RANK_ERROR`` of its rank."""
    for bound in (None if start is None else F.col("period") >= start, None if end is None else F.col("period") < end):
        sketches = sketches if bound is None else sketches.filter(bound)
    merged = sketches.groupBy(*labels).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("_all"))
    return merged.select(*labels, "n", *[F.kll_sketch_get_quantile_double("_all", F.lit(p).cast("double")).alias(f"p{round(p * 100)}") for p in points])


def success_rate(df: DataFrame, ts: str, ok: Column, window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Requests, success and error percentage per time window."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        df.groupBy(w.alias("w"))
        .agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
        .select(
            F.col("w.start").alias("window_start"),
            "total",
            "ok",
            (F.col("ok") / F.col("total") * 100).alias("success_pct"),
            ((F.col("total") - F.col("ok")) / F.col("total") * 100).alias("error_pct"),
        )
    )


def throughput(df: DataFrame, ts: str, window: str = "1 minute") -> DataFrame:
    return (
        df.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )


def average_by_window(df: DataFrame, ts: str, value: str, window: str = "15 minutes") -> DataFrame:
    return (
        df.groupBy(F.window(ts, window).alias("w"))
        .agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"))
        .select(F.col("w.start").alias("window_start"), "avg_value", "n")
    )

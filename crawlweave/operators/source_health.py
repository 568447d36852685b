"""Statistics, rank, health and smoothed response time per request source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.operators.ordered import number_rows

KEEP, GAIN = 0.8, 0.2  # fixed values: weights of the old average and of the new response


def source_stats(requests: DataFrame) -> DataFrame:
    """source, success, response_time to counts, rate and mean."""
    return (
        requests.groupBy("source")
        .agg(
            F.count("*").alias("requests"),
            F.count_if("success").alias("success_count"),
            F.avg("response_time").alias("avg_response_time"),
        )
        .withColumn("failure_count", F.col("requests") - F.col("success_count"))
        .withColumn("success_rate", F.col("success_count") / F.col("requests"))
    )


def source_rank(stats: DataFrame, top: int = 3) -> DataFrame:
    """Best sources by success rate and speed; a source never used scores 0.5."""
    score = F.when(
        F.col("requests") > 0, F.col("success_rate") * 0.7 + 0.3 / (F.col("avg_response_time") + 0.1)
    ).otherwise(0.5)
    return stats.withColumn("score", score).orderBy(F.desc("score"), "source").limit(top)


def source_health(requests: DataFrame, order: Sequence[str], min_requests: int = 10, rate: float = 0.5) -> DataFrame:
    """Final health after replaying all events in order.

    A success always heals. Failures after the last success only raise both the count and
    the failure share, so the last event sees the worst of them and decides alone. That
    turns the replay into one aggregate instead of a running window per source.
    """
    agg = requests.groupBy("source").agg(
        F.max_by("success", F.struct(*order)).alias("_last_ok"),
        F.count("*").alias("requests"),
        F.count_if(~F.col("success")).alias("failure_count"),
    )
    sick = (
        ~F.col("_last_ok")
        & (F.col("requests") >= min_requests)
        & (F.col("failure_count") / F.col("requests") > rate)
    )
    return agg.withColumn("status", F.when(sick, "unhealthy").otherwise("healthy")).drop("_last_ok")


def response_ema(
    requests: DataFrame, order: Sequence[str], value: str = "response_time", first_full: bool = True
) -> DataFrame:
    """Exponential moving average after the last event of each source.

    Unrolled, the average is a weighted sum whose weights depend only on the distance from
    the end, so it is a distributed numbering followed by a sum. Values before the first
    non-zero one leave the average at zero, and the first non-zero one enters with full weight
    (not so with ``first_full=False``, for rows that continue an older average).
    """
    numbered = number_rows(requests, ["source"], order, "_back", descending=True)
    fade = F.pow(F.lit(KEEP), F.col("_back") - 1)
    first = F.max(F.when(F.col(value) != 0, F.struct("_back", F.col(value).alias("v")))).alias("_first")
    agg = numbered.groupBy("source").agg(
        F.count("*").alias("requests"), F.sum(fade * F.col(value) * GAIN).alias("_sum"), first
    )
    head = F.coalesce(F.pow(F.lit(KEEP), F.col("_first._back") - 1) * F.col("_first.v") * KEEP, F.lit(0.0))
    total = F.col("_sum") + head if first_full else F.col("_sum")
    return agg.select("source", "requests", total.alias("ema"))

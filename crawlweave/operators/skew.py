"""Join helpers that look at sizes before choosing a strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000
PART_ROWS = 500_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measured, not guessed; the measurement stops at ``max_rows`` + 1 rows."""
    size = df.limit(max_rows + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")
    ).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def join_lookup(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS,
    salts: int = 32,
) -> DataFrame:
    """Join with a table that has one row per key.

    Broadcast when that table is measured to be small. Otherwise facts are salted and the
    table is repeated per salt, so a key with a third of all facts is shared by ``salts``
    tasks (AQE's own skew split does not apply when a side is an aggregate). A task hashes
    its part of the table, at most about ``PART_ROWS`` rows, and streams the facts past it,
    so facts as wide as whole texts are never sorted or held.
    """
    on = list(keys)
    if is_small(lookup, max_rows):
        return facts.join(F.broadcast(lookup), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), lookup.count() * salts // PART_ROWS + 1)
    salted, repeated = salted.repartition(parts, *on, "_salt"), repeated.repartition(parts, *on, "_salt")
    return salted.join(repeated.hint("shuffle_hash"), [*on, "_salt"], how).drop("_salt")


def join_groups(
    facts: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of rows with their group summary (one row per key, ``size`` = rows in the group).

    Groups of ``hot_rows`` or more are joined by broadcast: there can be at most
    (all rows / hot_rows) of them. Their rows then travel under a salt instead of their
    key, so the shuffle that serves the other groups stays even. ``facts`` is read once.
    """
    on = list(keys)
    values = [c for c in groups.columns if c not in on]
    hot = groups.filter(F.col(size) >= hot_rows).select(*on, F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(size) < hot_rows).select(
        *[F.col(k).alias(f"_k_{k}") for k in on], F.lit(0).alias("_salt"), F.struct(*values).alias("_cold")
    )
    is_hot = F.col("_hot").isNotNull()
    left = facts.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(*facts.columns), F.lit(65_536)).cast("int")).otherwise(0)
    )
    left = left.withColumns({f"_k_{k}": F.when(~is_hot, F.col(k)) for k in on})
    out = left.join(cold, [f"_k_{k}" for k in on] + ["_salt"], "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return out.filter(F.col("_v").isNotNull()).select(*facts.columns, *[F.col(f"_v.{v}").alias(v) for v in values])

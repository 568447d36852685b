"""Lengths of time."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def micros(spark: SparkSession, length: str) -> int:
    """Microseconds of an interval such as ``5 minutes``."""
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {length})")).first()[0]

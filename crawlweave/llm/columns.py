"""Whole rows as one column, whatever the input's columns are called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """The named columns of ``df``, or all, as one struct; names are taken literally."""
    return F.struct("*") if names is None else F.struct(*[F.col("`" + n.replace("`", "``") + "`") for n in names])

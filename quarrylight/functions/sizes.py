"""Broadcasts of what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of terms or questions that are sent to all tasks, some 20 MB at most.
SMALL = 200_000


def broadcast_if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with the hint if it has at most ``most`` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

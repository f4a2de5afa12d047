"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_of(df: DataFrame) -> int:
    """Bytes of a table's values as JSON, from one pass over it."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """df, to be broadcast if it has at most `most` bytes; else as it is, and the join shuffles."""
    return F.broadcast(df) if size_of(df) <= most else df

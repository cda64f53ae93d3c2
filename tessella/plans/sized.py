"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a stated query set (text and vector each) that one broadcast carries at most.
QUERY_ROWS = 10_000


def small_or_not(df: DataFrame, most: int = QUERY_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def blocks(df: DataFrame, key: str, most: int = QUERY_ROWS) -> list[DataFrame]:
    """A stated query set in blocks of about ``most`` rows by a hash of its key, each marked for broadcast."""
    n = -(-df.count() // most)
    if n <= 1:
        return [F.broadcast(df)]
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == b)) for b in range(n)]

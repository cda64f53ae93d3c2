"""Joins and groupings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows, so there are never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 256
#: ... and more rows than one task handles with ease.
HOT_FLOOR = 200_000


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame | None:
    """The keys of more than ``max(share * rows, floor)`` rows, or None.  At most ``1 / share`` rows, by construction."""
    total = df.count()
    if total <= floor:
        return None
    least = max(int(total * share), floor)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(*keys).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema) if rows else None


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def lookup_join(big: DataFrame, index: DataFrame, keys: list[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join ``big`` with ``index`` (unique by ``keys``) without sending a hot key's rows to one task.

    Rows of hot keys meet the index's few hot entries by broadcast (bounded, see ``hot_keys``);
    all others meet by an ordinary shuffle join.  ``hot`` None: an ordinary join.
    """
    if hot is None:
        return big.join(index, keys, how)
    small = F.broadcast(index.join(F.broadcast(hot), keys, "left_semi"))
    warm = big.join(F.broadcast(hot), keys, "left_semi").join(small, keys, how)
    cold = big.join(F.broadcast(hot), keys, "left_anti").join(index, keys, how)
    return warm.unionByName(cold)

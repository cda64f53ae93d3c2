"""Identifiers as people and services write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid_hex(c: Column) -> Column:
    """The 32 lower-case hex digits of a UUID, whatever its letter case or hyphens; null for any other text."""
    bare = F.lower(F.replace(c, F.lit("-"), F.lit("")))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def uuid_text(c: Column) -> Column:
    """A UUID in lower case with hyphens; any other text as it is."""
    h = uuid_hex(c)
    return F.when(
        h.isNotNull(),
        F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)),
    ).otherwise(c)


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | ~c.rlike("\\S")


def same_ids(df: DataFrame, column: str = "session_id") -> DataFrame:
    """``df`` with the ids of a column in one notation, so that equal UUIDs are one id."""
    return df.withColumn(column, uuid_text(F.col(column)))

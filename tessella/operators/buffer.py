"""Short-term window of a conversation: the last turns of a session, bounded, with a lifetime from its last push."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import same_ids

MAX_SIZE, TTL_SECONDS, WINDOW = 50, 86_400, 10


def window(turns: DataFrame, size: int = WINDOW, max_size: int = MAX_SIZE) -> DataFrame:
    """scope, session_id, id, place: the last turns by push order (``id``), oldest first; never more than ``max_size``."""
    w = Window.partitionBy("scope", "session_id")
    kept = same_ids(turns).withColumn("__n", F.row_number().over(w.orderBy(F.col("id").desc()))).where(F.col("__n") <= min(size, max_size))
    return kept.withColumn("place", F.row_number().over(w.orderBy("id"))).select("scope", "session_id", "id", "place")


def live(turns: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Sessions pushed to within the lifetime."""
    last = same_ids(turns).groupBy("scope", "session_id").agg(F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n_pushed"))
    return last.where(F.col("last_at") >= now - F.make_interval(secs=F.lit(ttl_seconds))).withColumn("n_held", F.least("n_pushed", F.lit(MAX_SIZE)))


def clear(turns: DataFrame, keys: DataFrame) -> DataFrame:
    return same_ids(turns).join(same_ids(keys).select("scope", "session_id").distinct(), ["scope", "session_id"], "left_anti")

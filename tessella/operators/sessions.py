"""Sessions: recent, active and idle ones, closing them.  Every operator works on all scopes at once; filter for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import same_ids
from tessella.operators.guards import need_limit

ACTIVE_SECONDS, IDLE_SECONDS = 43_200, 1_800


def stored(sessions: DataFrame) -> DataFrame:
    """One row per scope and id: of rows written again the first started, the last ended and the greatest summary stay."""
    return same_ids(sessions, "id").groupBy("scope", "id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max("summary").alias("summary"))


def create(sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Sessions with a new open one for each request (scope, id); a session that is there stays as it is.

    Ids come with the requests (``F.uuid()`` makes some), so that a batch that is run again creates the same sessions.
    """
    fresh = same_ids(requests, "id").where(F.col("scope").rlike("\\S") & F.col("id").isNotNull()).select("scope", "id").distinct()
    fresh = fresh.join(stored(sessions).select("scope", "id"), ["scope", "id"], "left_anti")
    none = F.lit(None)
    return stored(sessions).unionByName(fresh.select("scope", "id", now.alias("started_at"), none.cast("timestamp_ntz").alias("ended_at"), none.cast("string").alias("summary")))


def get(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """The sessions of ``keys`` (id, scope); a null or empty scope finds the id in any scope."""
    asked = same_ids(keys, "id").select(F.col("id").alias("__i"), F.coalesce("scope", F.lit("")).alias("__s")).distinct()
    rows = stored(sessions)
    return rows.join(asked, (rows["id"] == asked["__i"]) & ((asked["__s"] == "") | (asked["__s"] == rows["scope"])), "left_semi")


def recent(sessions: DataFrame, limit: int = 5) -> DataFrame:
    """The newest started sessions of each scope."""
    w = Window.partitionBy("scope").orderBy(F.col("started_at").desc_nulls_last(), F.col("id"))
    return stored(sessions).withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit)).select("scope", "id", "started_at", "place")


def active(sessions: DataFrame, now: Column, within_seconds: int = ACTIVE_SECONDS) -> DataFrame:
    """The newest open session of each scope that started within the time."""
    since = now - F.make_interval(secs=F.lit(within_seconds))
    rows = stored(sessions).where(F.col("ended_at").isNull() & (F.col("started_at") > since) & (F.col("started_at") <= now))
    # the greatest (start, id) without a sort
    return rows.groupBy("scope").agg(F.max(F.struct("started_at", "id")).alias("s")).select("scope", F.col("s.id").alias("id"), F.col("s.started_at").alias("started_at"))


def idle(turns: DataFrame, sessions: DataFrame, now: Column, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions with unstamped turns of no, an open or an outgrown session, whose last such turn is longer ago."""
    ended = stored(sessions).select("scope", F.col("id").alias("session_id"), F.col("ended_at"), F.lit(True).alias("known"))
    open_turns = same_ids(turns).where(F.col("consolidated_at").isNull()).join(ended, ["scope", "session_id"], "left")
    left = open_turns.where(F.col("known").isNull() | F.col("ended_at").isNull() | (F.col("created_at") > F.col("ended_at")))
    return (
        left.groupBy("scope", "session_id")
        .agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n_turns"))
        .where(F.col("last_at") < now - F.make_interval(secs=F.lit(idle_seconds)))
    )


def close(sessions: DataFrame, closing: DataFrame) -> DataFrame:
    """Sessions with those of ``closing`` (scope, session_id, ended_at, summary) closed; another scope's session of that id stays."""
    c = same_ids(closing).select("scope", F.col("session_id").alias("id"), F.col("ended_at").alias("__e"), F.col("summary").alias("__s"))
    met = stored(sessions).join(c, ["scope", "id"], "full")
    return met.select("scope", "id", F.coalesce("started_at", "__e").alias("started_at"), F.coalesce("__e", "ended_at").alias("ended_at"), F.coalesce("__s", "summary").alias("summary"))


def stamp(turns: DataFrame, closing: DataFrame) -> DataFrame:
    """Turns with ``consolidated_at`` set to the session's end where unstamped and no later than that."""
    c = same_ids(closing).select("scope", "session_id", F.col("ended_at").alias("__e"))
    turns = same_ids(turns)
    due = F.col("consolidated_at").isNull() & (F.col("created_at") <= F.col("__e"))
    return turns.join(c, ["scope", "session_id"], "left").withColumn("consolidated_at", F.when(due, F.col("__e")).otherwise(F.col("consolidated_at"))).drop("__e")

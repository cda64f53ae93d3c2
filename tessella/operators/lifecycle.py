"""Life of a document's versions: begun, drafted, claimed, committed, failed, expired; every step a change of frames.

State: ``versions`` (document_id, version, owner_key, state, reason, sha256, embed_model, size_bytes, est_tokens, created_at,
claimed_at, expires_at) and ``tombstones`` (owner_key, document_id, versions, kind, removed_at).  A step takes whole
frames of requests, so any number of documents moves at once, and gives the new state; nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROCESSING, AWAITING, READY, ERROR = "processing", "awaiting_confirmation", "ready", "error"
DRAFT_TTL_SECONDS, STALE_SECONDS = 86_400, 1_800
VERSION_SCHEMA = "document_id string, version int, owner_key string, state string, reason string, sha256 string, embed_model string, size_bytes bigint, est_tokens bigint, created_at timestamp_ntz, claimed_at timestamp_ntz, expires_at timestamp_ntz"
TOMBSTONE_SCHEMA = "owner_key string, document_id string, versions array<int>, kind string, removed_at timestamp_ntz"
KEY = ["document_id", "version"]


@dataclass
class Library:
    versions: DataFrame
    tombstones: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "Library":
        return cls(spark.createDataFrame([], VERSION_SCHEMA), spark.createDataFrame([], TOMBSTONE_SCHEMA))

    def _with(self, versions: DataFrame, gone: DataFrame | None = None, kind: str = "", now: Column | None = None) -> "Library":
        stones = self.tombstones
        if gone is not None:
            rows = gone.groupBy("owner_key", "document_id").agg(F.array_sort(F.collect_list("version")).alias("versions"))
            stones = stones.unionByName(rows.select("owner_key", "document_id", "versions", F.lit(kind).alias("kind"), now.alias("removed_at")))
        return Library(versions.select(*self.versions.columns), stones)


def begin(lib: Library, requests: DataFrame, now: Column) -> Library:
    """``requests``: owner_key, document_id, sha256, embed_model, size_bytes.

    A request of a known content and model is the version there is: ready stays, any other state starts again; a new one
    gets the next number of its document, several in order of their hash.
    """
    same = ["document_id", "sha256", "embed_model"]
    asked = requests.dropDuplicates(same)
    known = lib.versions.join(asked.select(*same).withColumn("__again", F.lit(True)), same, "left")
    again = F.col("__again").isNotNull() & (F.col("state") != READY)
    kept = known.withColumn("state", F.when(again, PROCESSING).otherwise(F.col("state"))).withColumn("reason", F.when(~again, F.col("reason"))).withColumn("claimed_at", F.when(again, now).otherwise(F.col("claimed_at"))).drop("__again")
    fresh = asked.join(lib.versions.select(*same).distinct(), same, "left_anti")
    top = lib.versions.groupBy("document_id").agg(F.max("version").alias("__top"))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("sha256", "embed_model"))
    made = fresh.join(top, "document_id", "left").select(
        "document_id", (F.coalesce("__top", F.lit(0)) + nth).cast("int").alias("version"), "owner_key", F.lit(PROCESSING).alias("state"), F.lit(None).cast("string").alias("reason"), "sha256", "embed_model",
        F.col("size_bytes").cast("bigint").alias("size_bytes"), F.lit(None).cast("bigint").alias("est_tokens"), now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("claimed_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"),
    )
    return lib._with(kept.select(*lib.versions.columns).unionByName(made))


def _marked(lib: Library, keys: DataFrame) -> DataFrame:
    asked = keys.select(*KEY).distinct().withColumn("__hit", F.lit(True))
    return lib.versions.join(asked, KEY, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def park(lib: Library, drafts: DataFrame, now: Column, ttl_seconds: int = DRAFT_TTL_SECONDS) -> Library:
    """Processing versions of ``drafts`` (document_id, version, est_tokens) wait for confirmation until they expire."""
    asked = drafts.select(*KEY, F.col("est_tokens").alias("__est")).dropDuplicates(KEY)
    rows = lib.versions.join(asked.withColumn("__hit", F.lit(True)), KEY, "left")
    rows = rows.withColumn("__due", F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("state") == PROCESSING))
    due = F.col("__due")
    rows = rows.withColumn("est_tokens", F.when(due, F.col("__est")).otherwise(F.col("est_tokens")))
    return lib._with(rows.withColumn("state", F.when(due, AWAITING).otherwise(F.col("state"))).withColumn("expires_at", F.when(due, now + F.make_interval(secs=F.lit(ttl_seconds))).otherwise(F.col("expires_at"))))


def claim(lib: Library, keys: DataFrame, now: Column) -> tuple[Library, DataFrame]:
    """(state, outcome per key: claimed, expired or missing); a claimed draft is processed again and leaves no draft."""
    rows = _marked(lib, keys)
    waiting = F.col("__hit") & (F.col("state") == AWAITING)
    rows = rows.withColumn("__live", F.coalesce(waiting & (F.col("expires_at") > now), F.lit(False)))
    live = F.col("__live")
    found = rows.where(waiting).select(*KEY, F.when(live, "claimed").otherwise("expired").alias("outcome"))
    outcome = keys.select(*KEY).distinct().join(found, KEY, "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    return lib._with(rows.withColumn("state", F.when(live, PROCESSING).otherwise(F.col("state"))).withColumn("claimed_at", F.when(live, now).otherwise(F.col("claimed_at"))).withColumn("expires_at", F.when(~live, F.col("expires_at")))), outcome


def commit(lib: Library, keys: DataFrame, now: Column) -> tuple[Library, DataFrame]:
    """(state, outcome per key: ready, superseded or deleted).

    Only the newest version of a document can become the served one; older versions go with one tombstone naming them.
    A late older version is dropped; a document that is not there is deleted.
    """
    top = lib.versions.groupBy("document_id").agg(F.max("version").alias("__top"))
    rows = _marked(lib, keys).join(top, "document_id")
    newest = F.col("version") == F.col("__top")
    serves = F.col("__hit") & newest & F.col("state").isin(PROCESSING, READY)
    late = F.col("__hit") & ~newest
    judged = rows.withColumn("__won", F.max(serves).over(Window.partitionBy("document_id"))).withColumn("__late", late)
    old = judged.where((F.col("__won") & ~newest) | F.col("__late"))
    kept = judged.where(~((F.col("__won") & ~newest) | F.col("__late")))
    new = kept.withColumn("state", F.when(serves, READY).otherwise(F.col("state"))).withColumn("expires_at", F.when(~serves, F.col("expires_at")))
    said = judged.where("__hit").select(*KEY, F.when(serves, "ready").otherwise("superseded").alias("outcome"))
    known = lib.versions.select("document_id").distinct().withColumn("__doc", F.lit(True))
    outcome = keys.select(*KEY).distinct().join(said, KEY, "left").join(known, "document_id", "left")
    outcome = outcome.select(*KEY, F.coalesce("outcome", F.when(F.col("__doc"), "superseded").otherwise("deleted")).alias("outcome"))
    return lib._with(new, old, "superseded", now), outcome


def fail(lib: Library, keys: DataFrame, now: Column) -> Library:
    """``keys``: document_id, version, reason.  Never a ready version; content goes, a tombstone stays."""
    asked = keys.select(*KEY, F.col("reason").alias("__why")).dropDuplicates(KEY).withColumn("__hit", F.lit(True))
    rows = lib.versions.join(asked, KEY, "left")
    rows = rows.withColumn("__due", F.coalesce(F.col("__hit"), F.lit(False)) & F.col("state").isin(PROCESSING, AWAITING))
    due = F.col("__due")
    ended = rows.withColumn("reason", F.when(due, F.col("__why")).otherwise(F.col("reason"))).withColumn("state", F.when(due, ERROR).otherwise(F.col("state")))
    return lib._with(ended, rows.where(due), "failed", now)


def _end(lib: Library, due: Column, reason: str, kind: str, now: Column, limit: int | None, order: str) -> Library:
    rows = lib.versions.withColumn("__due", F.coalesce(due, F.lit(False)))
    if limit is not None:
        first = rows.where("__due").orderBy(order, *KEY).limit(max(0, limit)).select(*KEY).withColumn("__first", F.lit(True))
        rows = rows.join(first, KEY, "left").withColumn("__due", F.col("__first").isNotNull())
    ended = rows.withColumn("state", F.when(F.col("__due"), ERROR).otherwise(F.col("state"))).withColumn("reason", F.when(F.col("__due"), reason).otherwise(F.col("reason")))
    return lib._with(ended, rows.where("__due"), kind, now)


def expire(lib: Library, now: Column, limit: int | None = 100) -> Library:
    """Drafts whose time is over, the oldest first."""
    return _end(lib, (F.col("state") == AWAITING) & (F.col("expires_at") <= now), "expired", "expired", now, limit, "expires_at")


def interrupt(lib: Library, now: Column, older_than_seconds: int = STALE_SECONDS, limit: int | None = 100) -> Library:
    """Versions that have been in processing for too long."""
    since = F.coalesce("claimed_at", "created_at")
    return _end(lib, (F.col("state") == PROCESSING) & (since < now - F.make_interval(secs=F.lit(older_than_seconds))), "interrupted", "interrupted", now, limit, "created_at")


def discard(lib: Library, keys: DataFrame, now: Column) -> tuple[Library, DataFrame]:
    """(state, outcome per key: discarded, not_a_draft or missing)."""
    rows = _marked(lib, keys)
    due = F.col("__hit") & (F.col("state") == AWAITING)
    said = rows.where("__hit").select(*KEY, F.when(F.col("state") == AWAITING, "discarded").otherwise("not_a_draft").alias("outcome"))
    outcome = keys.select(*KEY).distinct().join(said, KEY, "left").withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    ended = rows.withColumn("reason", F.when(due, "discarded").otherwise(F.col("reason"))).withColumn("state", F.when(due, ERROR).otherwise(F.col("state")))
    return lib._with(ended, rows.where(due), "discarded", now), outcome


def delete(lib: Library, documents: DataFrame, now: Column) -> Library:
    """All versions of the documents go; a tombstone each lists them."""
    keys = documents.select("document_id").distinct()
    return lib._with(lib.versions.join(keys, "document_id", "left_anti"), lib.versions.join(keys, "document_id", "left_semi"), "deleted", now)


def purge_subtree(lib: Library, prefix: str, now: Column) -> Library:
    from tessella.functions.text import in_subtree

    inside = F.coalesce(in_subtree(F.col("owner_key"), prefix), F.lit(False))
    return lib._with(lib.versions.where(~inside), lib.versions.where(inside), "purged", now)


def tombstones(lib: Library, prefix: str, limit: int = 100) -> DataFrame:
    from tessella.functions.text import in_subtree

    return lib.tombstones.where(in_subtree(F.col("owner_key"), prefix)).orderBy(F.col("removed_at").desc(), "document_id").limit(max(0, limit))


def prune_tombstones(lib: Library, before: Column) -> Library:
    return Library(lib.versions, lib.tombstones.where(~F.coalesce(F.col("removed_at") < before, F.lit(False))))


def listed(lib: Library) -> DataFrame:
    """owner_key, document_id, active_version, latest_version, status: a document's state is its latest attempt's."""
    served = F.max(F.when(F.col("state") == READY, F.col("version")))
    last = F.max(F.struct("version", "state"))
    return lib.versions.groupBy("owner_key", "document_id").agg(served.alias("active_version"), last.alias("__l")).select("owner_key", "document_id", "active_version", F.col("__l.version").alias("latest_version"), F.col("__l.state").alias("status"))


def stored_bytes(lib: Library, prefix: str) -> DataFrame:
    from tessella.functions.text import in_subtree

    return lib.versions.where(in_subtree(F.col("owner_key"), prefix)).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("stored_bytes"))

"""Published documents: creation within a ceiling, profiles, who may read what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import documents as docs_
from tessella.operators import lifecycle
from tessella.operators.guards import need_text

MEDIA_TYPES = ("text/markdown", "application/pdf")
DOCUMENT_SCHEMA = "owner_key string, document_id string, title string, profiles array<string>, media_type string, created_at timestamp_ntz"


def clean_profiles(c: Column) -> Column:
    """Trimmed, different, not blank, in order."""
    trimmed = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda p: p.isNotNull() & (p != ""))))


def create(documents: DataFrame, requests: DataFrame, now: Column, max_documents: int) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes per request: created, bad_media_type, blank_title or limit_reached).

    ``requests``: owner_key, document_id, title, profiles, media_type.  An owner's requests count in order of their id
    against the documents it has.
    """
    title = text.squeezed(F.coalesce("title", F.lit("")))
    have = documents.groupBy("owner_key").agg(F.count(F.lit(1)).alias("__have"))
    asked = requests.withColumn("title", title).join(have, "owner_key", "left")
    fault = F.when(~F.coalesce(F.col("media_type").isin(*MEDIA_TYPES), F.lit(False)), "bad_media_type").when(F.col("title") == "", "blank_title")
    asked = asked.withColumn("__fault", fault)
    nth = F.sum(F.col("__fault").isNull().cast("int")).over(Window.partitionBy("owner_key").orderBy("document_id"))
    judged = asked.withColumn("outcome", F.coalesce("__fault", F.when(F.coalesce("__have", F.lit(0)) + nth > max_documents, "limit_reached").otherwise("created")))
    made = judged.where("outcome = 'created'").select("owner_key", "document_id", "title", clean_profiles(F.col("profiles")).alias("profiles"), "media_type", now.alias("created_at"))
    return documents.select(*made.columns).unionByName(made), judged.select("owner_key", "document_id", "outcome")


def set_profiles(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: owner_key, document_id, profiles."""
    c = changes.select("owner_key", "document_id", F.col("profiles").alias("__p")).dropDuplicates(["owner_key", "document_id"]).withColumn("__hit", F.lit(True))
    met = documents.join(c, ["owner_key", "document_id"], "left")
    return met.withColumn("profiles", F.when(F.col("__hit"), clean_profiles(F.col("__p"))).otherwise(F.col("profiles"))).select(*documents.columns)


def readable(documents: DataFrame, lib: lifecycle.Library, owner: str, profile: str) -> DataFrame:
    """document_id, version, title: the served versions of the owner's documents that a profile may read."""
    served = lib.versions.where(F.col("state") == lifecycle.READY).groupBy("document_id").agg(F.max("version").alias("version"))
    mine = documents.where((F.col("owner_key") == need_text(owner, "owner")) & F.array_contains("profiles", need_text(profile, "profile")))
    return mine.join(served, "document_id").select("document_id", "version", "title")


def read_served(chunks: DataFrame, documents: DataFrame, lib: lifecycle.Library, owner: str, profile: str, after: int = -1, limit: int = docs_.PAGE) -> DataFrame:
    """The next chunks of what the profile may read; every denial is the same: no row."""
    return docs_.read(chunks.join(readable(documents, lib, owner, profile).select("document_id", "version"), ["document_id", "version"], "left_semi"), after, limit)


def outline(chunks: DataFrame, documents: DataFrame, lib: lifecycle.Library, owner: str, profile: str) -> DataFrame:
    """document_id, title, sections: readable documents with their section headings in order, none where a text never splits."""
    mine = readable(documents, lib, owner, profile)
    heads = docs_.sections(chunks.join(mine.select("document_id", "version"), ["document_id", "version"], "left_semi"))
    lists = heads.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "heading"))), lambda x: x["heading"]).alias("sections"))
    return mine.join(lists, "document_id", "left").select("document_id", "title", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"))

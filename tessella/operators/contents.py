"""What belongs to document versions: stored originals, staged and served chunks, drafts that wait with theirs.

Frames beside the ``lifecycle.Library``: ``originals`` (document_id, version, data), ``chunks`` (document_id, version, ordinal,
heading_path, page, content, embed_model, embedding) and ``drafts`` (document_id, version, pages, chunks as an array of
ordinal, heading_path, page, content).  Content follows the state of its version; ``sweep`` removes what no version holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scoring
from tessella.functions.text import in_subtree
from tessella.operators import lifecycle
from tessella.operators.guards import need_limit
from tessella.operators.lifecycle import AWAITING, KEY, PROCESSING, READY, Library

CHUNK = ["ordinal", "heading_path", "page", "content"]
PAGE = 50


def active(lib: Library) -> DataFrame:
    """document_id, version: what is served."""
    return lib.versions.where(F.col("state") == READY).groupBy("document_id").agg(F.max("version").alias("version"))


def original(originals: DataFrame, lib: Library, keys: DataFrame) -> DataFrame:
    """document_id, version, data of ``keys`` (document_id, version); without a version the served one's."""
    served = active(lib).withColumnRenamed("version", "__active")
    wanted = keys.join(served, "document_id", "left").select("document_id", F.coalesce("version", "__active").alias("version")).distinct()
    return originals.join(wanted, KEY, "left_semi")


def stored_bytes(originals: DataFrame, lib: Library, prefix: str) -> DataFrame:
    """stored_bytes: lengths of the originals of a subtree of owners."""
    mine = lib.versions.where(in_subtree(F.col("owner_key"), prefix)).select(*KEY)
    return originals.join(mine, KEY, "left_semi").agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("stored_bytes"))


def stage(chunks: DataFrame, lib: Library, new: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcomes: document_id, version, outcome) after adding ``new`` (KEY, CHUNK, embedding).

    Only versions in processing take chunks; a version with one vector of another width or not finite takes none.  Of an
    ordinal given twice the later content counts; the model is the version's.
    """
    judged = new.groupBy(*KEY).agg(F.min(scoring.finite_vector(F.col("embedding"), width)).alias("__fine"))
    asked = judged.join(lib.versions.select(*KEY, "state", F.col("embed_model").alias("__model")), KEY, "left")
    outcome = F.when(F.col("state").isNull(), "missing").when(F.col("state") != PROCESSING, "not_processing").when(~F.col("__fine"), "bad_vector").otherwise("staged")
    asked = asked.withColumn("outcome", outcome)
    taken = new.join(asked.where("outcome = 'staged'").select(*KEY, "__model"), KEY)
    last = taken.groupBy(*KEY, "ordinal").agg(F.max(F.struct("content", "heading_path", "page", "embedding", "__model")).alias("c"))
    rows = last.select(*KEY, "ordinal", "c.heading_path", "c.page", "c.content", F.col("c.__model").alias("embed_model"), "c.embedding")
    kept = chunks.join(rows.select(*KEY, "ordinal"), [*KEY, "ordinal"], "left_anti")
    return kept.select(*rows.columns).unionByName(rows), asked.select(*KEY, "outcome")


def save_drafts(drafts: DataFrame, lib: Library, new: DataFrame) -> DataFrame:
    """Drafts with those of ``new`` (KEY, CHUNK), one row per version that waits; a version's draft is replaced whole."""
    waits = lib.versions.where(F.col("state") == AWAITING).select(*KEY)
    entry = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "heading_path", F.col("page").cast("int").alias("page"), "content")
    rows = new.groupBy(*KEY).agg(F.countDistinct("page").cast("int").alias("pages"), F.array_sort(F.collect_list(entry)).alias("chunks")).join(waits, KEY, "left_semi")
    return drafts.join(rows.select(*KEY), KEY, "left_anti").unionByName(rows)


def pending(drafts: DataFrame, lib: Library, owner: str) -> DataFrame:
    """document_id, version, n_chunks, pages, est_tokens, expires_at, place: an owner's waiting drafts, the first to expire first."""
    mine = lib.versions.where((F.col("owner_key") == owner) & (F.col("state") == AWAITING)).select(*KEY, "est_tokens", "expires_at")
    w = Window.orderBy("expires_at", *KEY)
    return drafts.join(mine, KEY).select(*KEY, F.size("chunks").alias("n_chunks"), "pages", "est_tokens", "expires_at", F.row_number().over(w).alias("place"))


def drafted(drafts: DataFrame) -> DataFrame:
    """The chunks of drafts as rows."""
    return drafts.select(*KEY, F.explode("chunks").alias("c")).select(*KEY, "c.*")


def version_text(chunks: DataFrame, drafts: DataFrame, lib: Library, keys: DataFrame, page: int | None = None, after: int = -1, limit: int = PAGE) -> DataFrame:
    """document_id, version, ordinal, heading_path, page, content, has_more of ``keys`` (document_id, version; null: the served one).

    A version in waiting is read from its draft.  ``page`` filters documents that have pages; others come whole.
    """
    served = active(lib).withColumnRenamed("version", "__active")
    wanted = keys.join(served, "document_id", "left").select("document_id", F.coalesce("version", "__active").alias("version")).distinct()
    live = lib.versions.where(F.col("state").isin(READY, AWAITING)).select(*KEY, "state").join(wanted, KEY, "left_semi")
    rows = chunks.select(*KEY, *CHUNK).join(live.where(F.col("state") == READY).select(*KEY), KEY, "left_semi").unionByName(drafted(drafts).select(*KEY, *CHUNK).join(live.where(F.col("state") == AWAITING).select(*KEY), KEY, "left_semi"))
    if page is not None:
        paged = F.max(F.col("page").isNotNull()).over(Window.partitionBy(*KEY))
        rows = rows.withColumn("__paged", paged).where(~F.col("__paged") | (F.col("page") == page)).drop("__paged")
    n = need_limit(limit)
    own = Window.partitionBy(*KEY)
    first = rows.where(F.col("ordinal") > after).withColumn("__n", F.row_number().over(own.orderBy("ordinal"))).where(F.col("__n") <= n + 1)
    return first.withColumn("has_more", F.max("__n").over(own) > n).where(F.col("__n") <= n).drop("__n")


def sweep(lib: Library, originals: DataFrame, chunks: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(originals, chunks, drafts) that a version still holds: those of failed, superseded and deleted versions go."""
    live = lib.versions.where(F.col("state").isin(PROCESSING, AWAITING, READY))
    waits = live.where(F.col("state") == AWAITING).select(*KEY)
    return originals.join(live.select(*KEY), KEY, "left_semi"), chunks.join(live.where(F.col("state") != AWAITING).select(*KEY), KEY, "left_semi"), drafts.join(waits, KEY, "left_semi")


def probe(lib: Library, originals: DataFrame, chunks: DataFrame, drafts: DataFrame, owner: str = "~nobody") -> dict[str, int]:
    """Rows that every read gives for an owner that holds nothing: a check that all of them run, and give none."""
    nobody = lib.versions.where(F.col("owner_key") == owner)
    keys = nobody.select(*KEY)
    empty = Library(nobody, lib.tombstones.where(F.col("owner_key") == owner))
    reads = {
        "listed": lifecycle.listed(empty), "tombstones": lifecycle.tombstones(empty, owner), "original": original(originals, empty, keys),
        "pending": pending(drafts, empty, owner), "text": version_text(chunks, drafts, empty, keys),
    }
    return {name: df.count() for name, df in reads.items()}

"""Ingestion: text to chunks to embedded chunks, with injected extractor and embedder; outcomes are rows, not exceptions."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import chunking, contents, lifecycle
from tessella.plans.durable import cut

CHARS_PER_TOKEN, STAGE_BATCH = 4, 200
CHUNK_SCHEMA = "document_id string, version int, ordinal int, heading_path array<string>, page int, content string"


def prepare(documents: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig(), max_bytes: int = 10 << 20) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcomes) of ``documents``: document_id, version, title, text.

    Outcome: ready_to_embed with its estimated tokens, or empty, too_large or over_limit.
    """
    sized = documents.withColumn("__bytes", F.octet_length(F.col("text")))
    fit = sized.where(F.col("__bytes") <= max_bytes).drop("__bytes")
    key = F.to_json(F.struct("document_id", "version"))
    cut = chunking.chunk_documents(fit.withColumn("__key", key), config, "__key", "title", "text")
    ids = F.from_json("__key", "document_id string, version int")
    chunks = cut.where("ordinal >= 0").select(ids.alias("k"), "ordinal", "heading_path", F.lit(None).cast("int").alias("page"), "content").select("k.document_id", "k.version", "ordinal", "heading_path", "page", "content")
    over = cut.where("ordinal < 0").select(ids.alias("k")).select("k.*", F.lit(True).alias("__over"))
    sums = chunks.groupBy("document_id", "version").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.ceil(F.length("content") / CHARS_PER_TOKEN)).alias("est_tokens"))
    met = sized.select("document_id", "version", "__bytes").join(sums, ["document_id", "version"], "left").join(over, ["document_id", "version"], "left")
    outcome = F.when(F.col("__bytes") > max_bytes, "too_large").when(F.col("__over"), "over_limit").when(F.col("n_chunks").isNull(), "empty").otherwise("ready_to_embed")
    return chunks, met.select("document_id", "version", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("est_tokens", F.lit(0)).alias("est_tokens"), outcome.alias("outcome"))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, width: int, batch: int = STAGE_BATCH, check: bool = True) -> DataFrame:
    """Chunks with embed_model and embedding; with ``check`` a vector of another width or with numbers that are not finite fails the task."""
    columns = chunks.columns

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch][columns].copy()
                vectors = embedder(part["content"].fillna("").tolist())
                for v in vectors if check else ():
                    if len(v) != width or not all(math.isfinite(x) for x in v):
                        raise ValueError(f"the embedder of {model} gave a vector of {len(v)} numbers or one that is not finite; {width} are right")
                part["embed_model"], part["embedding"] = model, [[float(x) for x in v] for v in vectors]
                yield part

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{schema}, embed_model string, embedding array<float>")


def ingest(library: Shelf, documents: DataFrame, model: str, width: int, embedder: Callable[[list[str]], list[list[float]]], now: Column, gate: Column | None = None, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> tuple[Shelf, DataFrame]:
    """(shelf, outcomes) of ``documents`` (owner_key, document_id, title, data: the text's bytes): drafted and committed at once."""
    drafted, said = draft(library, documents, model, now, config)
    keys = said.where(F.col("outcome") == lifecycle.AWAITING).select("document_id", "version")
    done, committed = commit(drafted, keys, model, width, embedder, now, gate)
    final = said.join(committed.withColumnRenamed("outcome", "__o"), ["document_id", "version"], "left")
    return done, final.select("document_id", "version", F.coalesce("__o", "outcome").alias("outcome"))


@dataclass
class Shelf:
    """A library with what its versions hold."""

    lib: lifecycle.Library
    originals: DataFrame
    chunks: DataFrame
    drafts: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "Shelf":
        made = spark.createDataFrame
        part = "ordinal:int,heading_path:array<string>,page:int,content:string"
        return cls(lifecycle.Library.empty(spark), made([], "document_id string, version int, data binary"), made([], f"{CHUNK_SCHEMA}, embed_model string, embedding array<float>"), made([], f"document_id string, version int, pages int, chunks array<struct<{part}>>"))

    def durable(self) -> "Shelf":
        return Shelf(lifecycle.Library(cut(self.lib.versions), cut(self.lib.tombstones)), cut(self.originals), cut(self.chunks), cut(self.drafts))


def draft(library: Shelf, documents: DataFrame, model: str, now: Column, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> tuple[Shelf, DataFrame]:
    """(shelf, outcomes: document_id, version, outcome): versions begun by content, cut to chunks and parked with them.

    A content and model that is served already is ``unchanged``; a text that gives no chunks, or too many, ends its version.
    """
    sha = F.sha2(F.col("data"), 256)
    asked = documents.select("owner_key", "document_id", "title", "data", sha.alias("sha256"), F.lit(model).alias("embed_model"), F.octet_length("data").cast("bigint").alias("size_bytes"))
    begun = lifecycle.begin(library.lib, asked.select("owner_key", "document_id", "sha256", "embed_model", "size_bytes"), now)
    begun = lifecycle.Library(cut(begun.versions), begun.tombstones)
    met = cut(asked.join(begun.versions.select("document_id", "sha256", "embed_model", "version", "state"), ["document_id", "sha256", "embed_model"]))
    work = met.where(F.col("state") == lifecycle.PROCESSING)
    chunks, outcomes = prepare(work.select("document_id", "version", "title", F.decode("data", "UTF-8").alias("text")), config)
    chunks, outcomes = cut(chunks), cut(outcomes)
    fine = outcomes.where("outcome = 'ready_to_embed'")
    parked = lifecycle.park(begun, fine.select("document_id", "version", "est_tokens"), now)
    ended = lifecycle.fail(parked, outcomes.where("outcome <> 'ready_to_embed'").select("document_id", "version", F.col("outcome").alias("reason")), now)
    ended = lifecycle.Library(cut(ended.versions), cut(ended.tombstones))
    kept = library.originals.join(work.select("document_id", "version"), ["document_id", "version"], "left_anti").unionByName(work.select("document_id", "version", "data"))
    drafts = contents.save_drafts(library.drafts, ended, chunks)
    originals, rows, drafts = contents.sweep(ended, kept, library.chunks, drafts)
    said = met.join(outcomes.select("document_id", "version", F.col("outcome").alias("__o")), ["document_id", "version"], "left")
    outcome = F.when(F.col("state") == lifecycle.READY, "unchanged").when(F.col("__o") == "ready_to_embed", lifecycle.AWAITING).otherwise(F.col("__o"))
    return Shelf(ended, originals, rows, drafts), said.select("document_id", "version", outcome.alias("outcome"))


def commit(library: Shelf, keys: DataFrame, model: str, width: int, embedder: Callable[[list[str]], list[list[float]]], now: Column, gate: Column | None = None) -> tuple[Shelf, DataFrame]:
    """(shelf, outcomes: document_id, version, outcome) of confirmed drafts: claimed, gated, embedded, staged, swapped in.

    ``gate``: a condition over a version's row (est_tokens, owner_key, ...); drafts it refuses end as ``gate_refused``.
    Drafts past their time are ``expired``, others that are none ``not_prepared``.
    """
    claimed, said = lifecycle.claim(library.lib, keys, now)
    claimed, said = lifecycle.Library(cut(claimed.versions), claimed.tombstones), cut(said)
    mine = claimed.versions.join(said.where("outcome = 'claimed'").select("document_id", "version"), ["document_id", "version"], "left_semi")
    passes = F.coalesce(gate, F.lit(False)) if gate is not None else F.lit(True)
    refused = mine.where(~passes).select("document_id", "version", F.lit("gate_refused").alias("reason"))
    gated = lifecycle.fail(claimed, refused, now)
    texts = contents.drafted(library.drafts).join(mine.where(passes).select("document_id", "version"), ["document_id", "version"], "left_semi")
    vectors = cut(embed(texts, embedder, model, width, check=False))
    rows, staged = contents.stage(library.chunks, gated, vectors.drop("embed_model"), width)
    staged = cut(staged)
    broken = lifecycle.fail(gated, staged.where("outcome = 'bad_vector'").select("document_id", "version", F.lit("bad_vector").alias("reason")), now)
    swapped, won = lifecycle.commit(broken, staged.where("outcome = 'staged'").select("document_id", "version"), now)
    final = lifecycle.Library(cut(swapped.versions), cut(swapped.tombstones))
    originals, rows, drafts = contents.sweep(final, library.originals, rows, library.drafts)
    out = said.join(won.withColumnRenamed("outcome", "__w"), ["document_id", "version"], "left").join(staged.withColumnRenamed("outcome", "__s"), ["document_id", "version"], "left").join(refused, ["document_id", "version"], "left")
    outcome = F.coalesce("reason", F.when(F.col("__s") == "bad_vector", "bad_vector"), "__w", F.when(F.col("outcome") == "expired", "expired").otherwise("not_prepared"))
    return Shelf(final, originals, rows, drafts), out.select("document_id", "version", outcome.alias("outcome"))


def reindex(library: Shelf, keys: DataFrame, titles: DataFrame, model: str, width: int, embedder: Callable[[list[str]], list[list[float]]], now: Column, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> tuple[Shelf, DataFrame]:
    """Documents of ``keys`` (document_id) made anew, from their served originals, with another model; without one: ``no_original``."""
    served = contents.original(library.originals, library.lib, keys.select("document_id", F.lit(None).cast("int").alias("version")))
    owners = library.lib.versions.groupBy("document_id").agg(F.first("owner_key").alias("owner_key"))
    again = served.select("document_id", "data").join(owners, "document_id").join(titles.select("document_id", "title"), "document_id", "left")
    shelf, said = ingest(library, again, model, width, embedder, now, None, config)
    none = keys.select("document_id").distinct().join(served, "document_id", "left_anti").select("document_id", F.lit(None).cast("int").alias("version"), F.lit("no_original").alias("outcome"))
    return shelf, said.unionByName(none)


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic bag of hashed words, for tests and benches."""
    import hashlib
    import re

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in re.findall(r"\w+", t.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest(), 16) % width] += 1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out

    return run


class TokensPerMinute:
    """At most ``per_minute`` tokens in a minute, kept as one moment: when everything granted so far is paid for.

    Credit of up to a minute may be drawn ahead of that moment; a request of more than a minute's tokens costs one
    whole minute, so it goes once nothing is owed.
    """

    MINUTE = 60.0

    def __init__(self, per_minute: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if per_minute <= 0:
            raise ValueError("per_minute must be positive")
        self.per_minute, self.clock, self.sleep = per_minute, clock, sleep
        self.paid = clock()

    def take(self, tokens: int) -> float:
        """Seconds waited for ``tokens``."""
        cost = self.MINUTE * min(1.0, max(0, tokens) / self.per_minute)
        now = self.clock()
        wait = max(0.0, max(self.paid, now) + cost - self.MINUTE - now)
        self.paid = max(self.paid, now) + cost
        if wait:
            self.sleep(wait)
        return wait


def paced(requests: DataFrame, per_minute: int, order: str = "n", tokens: str = "tokens") -> DataFrame:
    """The same schedule for a batch that comes at once: ``starts_at``, seconds from the beginning, for every request in order."""
    if per_minute <= 0:
        raise ValueError("per_minute must be positive")
    cost = F.least(F.lit(1.0), F.greatest(F.lit(0), F.col(tokens)) / F.lit(per_minute)) * TokensPerMinute.MINUTE
    owed = F.sum(cost).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return requests.withColumn("starts_at", F.greatest(F.lit(0.0), owed - TokensPerMinute.MINUTE))


def entities_to_nodes(entities: pd.DataFrame | DataFrame) -> DataFrame:
    """scope, label, node_type of entities (scope, label, optional kind): blank labels go, unknown kinds are concepts."""
    from tessella.functions import text
    from tessella.operators.graph import node_type

    kind = node_type(F.col("kind")) if "kind" in entities.columns else F.lit("CONCEPT")
    return entities.where(F.coalesce(F.trim("label"), F.lit("")) != "").select("scope", text.squeezed(F.col("label")).alias("label"), kind.alias("node_type"))

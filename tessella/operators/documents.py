"""Versioned documents: serving, sections, hybrid search, retention.  Versions are derived from the chunks that are there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scoring, text
from tessella.operators.guards import need_limit
from tessella.plans.sized import blocks

MAX_SECTIONS, CHARS_PER_TOKEN, PAGE = 50, 4, 50


def versions(chunks: DataFrame) -> DataFrame:
    """document_id, version, embed_model, n_chunks, est_tokens of every version."""
    return chunks.groupBy("document_id", "version").agg(F.max("embed_model").alias("embed_model"), F.count(F.lit(1)).alias("n_chunks"), F.sum(F.ceil(F.length("content") / CHARS_PER_TOKEN)).alias("est_tokens"))


def served(chunks: DataFrame) -> DataFrame:
    """document_id, version: the newest one is served."""
    return chunks.groupBy("document_id").agg(F.max("version").alias("version"))


def swap(chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(chunks of the served versions, tombstones: document_id, kind, versions, removed_at) after committing the newest ones."""
    top = served(chunks)
    old = chunks.select("document_id", "version").distinct().join(top.withColumnRenamed("version", "__top"), "document_id").where(F.col("version") < F.col("__top"))
    stones = old.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("version")), lambda v: v.cast("string")), ",").alias("versions"))
    return chunks.join(top, ["document_id", "version"], "left_semi"), stones.select("document_id", F.lit("superseded").alias("kind"), "versions", now.alias("removed_at"))


def sections(chunks: DataFrame) -> DataFrame:
    """document_id, place, heading: headings of the first depth that has two different ones, in order of their first chunk."""
    rows = chunks.join(served(chunks), ["document_id", "version"], "left_semi").select("document_id", "ordinal", F.posexplode("heading_path").alias("depth", "heading"))
    rows = rows.withColumn("heading", text.squeezed(F.col("heading"))).where(F.col("heading") != "")
    firsts = rows.groupBy("document_id", "depth", "heading").agg(F.min("ordinal").alias("first"))
    depth = firsts.groupBy("document_id", "depth").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("document_id").agg(F.min("depth").alias("depth"))
    w = Window.partitionBy("document_id").orderBy("first", "heading")
    return firsts.join(depth, ["document_id", "depth"], "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_SECTIONS).select("document_id", "place", "heading")


def unavailable_models(chunks: DataFrame, query_model: str | None) -> DataFrame:
    """embed_model of the served versions that the query's vector cannot be compared with."""
    models = chunks.join(served(chunks), ["document_id", "version"], "left_semi").where(F.col("embed_model").isNotNull()).select("embed_model").distinct()
    return models if query_model is None else models.where(F.col("embed_model") != query_model)


def search(chunks: DataFrame, queries: DataFrame, query_model: str | None = None, limit: int = 5, weights: tuple[float, float] = (scoring.VECTOR_WEIGHT, scoring.LEXICAL_WEIGHT), vectors_used: bool | None = None) -> DataFrame:
    """query_id, document_id, version, ordinal, score, place.

    All or none: vectors count only if every served model is the query's (``vectors_used`` says so when known); then
    every served chunk is a candidate, else those with a word of the query.  ``queries`` (query_id, query_text,
    query_vector) are stated; they meet all chunks in blocks of a checked size, one pass each.
    """
    use = query_model is not None and (unavailable_models(chunks, query_model).limit(1).count() == 0 if vectors_used is None else vectors_used)
    rows = chunks.join(served(chunks), ["document_id", "version"], "left_semi").select("document_id", "version", "ordinal", "embedding", F.array_distinct(words(F.col("content"))).alias("__c"))
    asked = queries.select("query_id", "query_vector", F.array_distinct(words(F.col("query_text"))).alias("__q"))
    met = reduce(DataFrame.unionByName, (rows.join(b, F.lit(True)) for b in blocks(asked, "query_id")))
    lexical = text.share(F.col("__q"), F.col("__c"))
    score = scoring.mean_score(scoring.cosine(F.col("embedding"), F.col("query_vector")) if use else None, lexical, *weights)
    met = met.withColumn("__l", lexical).withColumn("score", F.round(score, 6))
    if not use:
        met = met.where(F.col("__l") > 0)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id", "version", "ordinal")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit)).select("query_id", "document_id", "version", "ordinal", "score", "place")


def words(c: Column) -> Column:
    """Words of the folded text, none left out."""
    return F.regexp_extract_all(text.fold(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def read(chunks: DataFrame, after: int = -1, limit: int = PAGE) -> DataFrame:
    """document_id, ordinal, content, has_more: the next chunks of every served document."""
    rows = chunks.join(served(chunks), ["document_id", "version"], "left_semi").where(F.col("ordinal") > after)
    w = Window.partitionBy("document_id").orderBy("ordinal")
    n = need_limit(limit)
    counted = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n + 1).withColumn("has_more", F.max("__n").over(Window.partitionBy("document_id")) > n)
    return counted.where(F.col("__n") <= n).select("document_id", "ordinal", "content", "has_more")


def stale(chunks: DataFrame, embed_model: str) -> DataFrame:
    """document_id, version, embed_model of served versions made with another model."""
    return versions(chunks).join(served(chunks), ["document_id", "version"], "left_semi").where(~F.col("embed_model").eqNullSafe(F.lit(embed_model))).select("document_id", "version", "embed_model")

"""Two-pass reranking of retrieved memories."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scoring

POSITION_STEP = 0.05


def first_pass(hits: DataFrame, now: Column, boosts: dict[str, float] | None = None, half_life_days: float = 7.0, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``hits``: group columns, id, place from 1, created_at, category, optional base_score.  Adds rank_score and new_place.

    Similarity is the base score or falls with the place; an unknown category's boost is 0.5; equal scores keep their order.
    """
    by_place = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(POSITION_STEP) * (F.col("place") - 1))
    similar = F.coalesce(F.col("base_score"), by_place) if "base_score" in hits.columns else by_place
    boost = F.lit(0.5)
    for name, b in sorted((boosts or {}).items()):
        boost = F.when(F.lower("category") == name.lower(), F.lit(float(b))).otherwise(boost)
    score = similar * scoring.SIMILARITY_WEIGHT + scoring.recency(F.col("created_at"), now, half_life_days) * scoring.RECENCY_WEIGHT + boost * scoring.CATEGORY_WEIGHT
    w = Window.partitionBy(*group).orderBy(F.col("rank_score").desc(), F.col("place"))
    return hits.withColumn("rank_score", F.round(score, 6)).withColumn("new_place", F.row_number().over(w))


def second_pass(ranked: DataFrame, score_pairs: Callable[[list[str], list[str]], list[float]], k: int, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best ``k`` of a shortlist of max(2k, 20) by an injected scorer of (query_text, content) pairs; equal scores keep their order."""
    short = ranked.where(F.col("new_place") <= max(2 * k, 20))

    @F.pandas_udf("double")
    def judged(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(score_pairs(q.tolist(), c.tolist()), dtype="float64")

    w = Window.partitionBy(*group).orderBy(F.col("cross_score").desc(), F.col("new_place"))
    return short.withColumn("cross_score", judged("query_text", "content")).withColumn("final_place", F.row_number().over(w)).where(F.col("final_place") <= k)

"""Column expressions over vectors, times and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR_WEIGHT, LEXICAL_WEIGHT, FEEDBACK_WEIGHT = 0.60, 0.40, 0.05
SIMILARITY_WEIGHT, RECENCY_WEIGHT, CATEGORY_WEIGHT = 0.60, 0.25, 0.15


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def usable_vector(v: Column, width: int) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == width) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def finite_vector(v: Column, width: int) -> Column:
    """Of the right length, with finite numbers only; zeros are allowed."""
    return F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, of another width or all zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm).otherwise(F.lit(0.0))


def clamp_unit(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def check_weights(*weights: float) -> float:
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must not be negative and must not all be zero")
    return float(sum(weights))


def mean_score(vector: Column | None, lexical: Column, w_vector: float = VECTOR_WEIGHT, w_lexical: float = LEXICAL_WEIGHT) -> Column:
    """Weighted mean of two scores in [0, 1]; without a vector exactly the lexical one."""
    total = check_weights(w_vector, w_lexical)
    if vector is None:
        return clamp_unit(lexical)
    return (clamp_unit(vector) * w_vector + clamp_unit(lexical) * w_lexical) / total


def recency(created: Column, now: Column, half_life_days: float = 7.0) -> Column:
    """Half after each half-life; 0.5 where the time is unknown, 1 for the future."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(86_400e6))
    return F.when(created.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age / half_life_days))

"""Long-term memories: upsert, hybrid retrieval, feedback, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scoring, text
from tessella.operators.guards import need_limit, need_text
from tessella.plans.sized import small_or_not

KEY = ["scope", "category", "content"]
FEEDBACK_LIMIT = 10.0


def save(batch: DataFrame, stored: DataFrame | None = None, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """One row per scope, category and content after writing in the given order.

    The first write fixes id, created_at, first_heard_by and feedback_score; the last one sets the confidence and the
    last one that has a vector the embedding.  All in one aggregation; a stored table counts as written before.
    """
    rows = batch.withColumn("__old", F.lit(1))
    if stored is not None:
        rows = stored.select(*batch.columns).withColumn("__old", F.lit(0)).unionByName(rows)
    seq = F.struct("__old", *order)
    first = F.struct("id", "created_at", "first_heard_by", "feedback_score")
    return (
        rows.groupBy(*KEY)
        .agg(
            F.min_by(first, seq).alias("f"),
            F.max_by("confidence", seq).alias("confidence"),
            F.max_by("embedding", F.when(F.col("embedding").isNotNull(), seq)).alias("embedding"),
            F.count(F.lit(1)).alias("n_writes"),
        )
        .select("f.id", *KEY, "confidence", "f.feedback_score", "f.first_heard_by", "embedding", "f.created_at", "n_writes")
    )


def recent(memories: DataFrame, limit: int = 50, categories: list[str] | None = None) -> DataFrame:
    rows = memories if categories is None else memories.where(F.col("category").isin(*categories))
    w = Window.partitionBy("scope").orderBy(F.col("created_at").desc_nulls_last(), F.col("id"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit)).select("scope", "id", "place")


def retrieve(
    memories: DataFrame,
    queries: DataFrame,
    limit: int = 5,
    weights: tuple[float, float, float] = (scoring.VECTOR_WEIGHT, scoring.LEXICAL_WEIGHT, scoring.FEEDBACK_WEIGHT),
    match_all: bool = False,
    width: int = 64,
) -> DataFrame:
    """scope, query_id, id, score, place: the best memories of each query of the same scope.

    ``queries``: scope, query_id, query_text, query_vector; either may be null.  The similarity counts only where the
    query has a vector, and then rows without a usable one are left out; the share of the query's words counts where it
    has text.  ``match_all``: only rows that have all its words.  Queries meet memories by scope.
    """
    w_vector, w_lexical, w_feedback = weights
    scoring.check_weights(*weights)
    # a query's words are cut once, a memory's once
    asked = queries.select("scope", "query_id", "query_vector", text.terms(F.col("query_text")).alias("__q"))
    rows = memories.select("scope", "id", "embedding", "feedback_score", text.terms(F.col("content")).alias("__c"), scoring.usable_vector(F.col("embedding"), width).alias("__ok"))
    # few queries go to the memories; many meet them by scope
    met = rows.join(small_or_not(asked), "scope")
    has_vector, has_text = F.col("query_vector").isNotNull(), F.coalesce(F.size("__q"), F.lit(0)) > 0
    similar = F.when(has_vector, scoring.cosine(F.col("embedding"), F.col("query_vector"))).otherwise(0.0)
    lexical = F.when(has_text, text.share(F.col("__q"), F.col("__c"))).otherwise(0.0)
    met = met.where(~has_vector | F.col("__ok"))
    if match_all:
        met = met.where(~has_text | (F.size(F.array_except("__q", "__c")) == 0))
    score = similar * w_vector + lexical * w_lexical + F.coalesce(F.col("feedback_score").cast("double"), F.lit(0.0)) * w_feedback
    scored = met.select("scope", "query_id", "id", F.round(score, 6).alias("score"))
    w = Window.partitionBy("scope", "query_id").orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit))


def scan(memories: DataFrame, after_id: str = "", limit: int = 1000) -> DataFrame:
    """The next page by id."""
    return memories.where(F.col("id") > after_id).orderBy("id").limit(need_limit(limit)).select("id", "scope")


def adjust_feedback(memories: DataFrame, words: str, delta: float, limit: int = 10) -> DataFrame:
    """Memories with ``delta`` added to the first ``limit`` rows of each scope that share a word, within the bounds."""
    q = text.terms(F.lit(words))
    shares = F.coalesce(F.arrays_overlap(text.terms(F.col("content")), q), F.lit(False))
    # only rows that share a word are ranked, with a limit that cuts before the shuffle; the few that count are joined back
    w = Window.partitionBy("scope").orderBy("created_at", "id")
    hit = memories.where(shares).select("scope", "id", "created_at").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= need_limit(limit))
    met = memories.join(hit.select("id", F.lit(True).alias("touched")), "id", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    moved = F.greatest(F.lit(-FEEDBACK_LIMIT), F.least(F.lit(FEEDBACK_LIMIT), F.coalesce(F.col("feedback_score"), F.lit(0.0)) + F.lit(delta)))
    return met.withColumn("feedback_score", F.when(F.col("touched"), moved).otherwise(F.col("feedback_score"))).select(*memories.columns, "touched")


def counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("scope").agg(F.count(F.lit(1)).alias("n_memories"))


def doomed(older_than: Column | None = None, category: str | None = None, max_confidence: float | None = None) -> Column:
    """Which memories a retention rule removes; one predicate for the dry run and the real one.  A null never matches."""
    if older_than is None and category is None and max_confidence is None:
        raise ValueError("a retention rule needs a condition")
    out = F.lit(True)
    if older_than is not None:
        out = out & (F.col("created_at") < older_than)
    if category is not None:
        out = out & (F.col("category") == category)
    if max_confidence is not None:
        out = out & (F.col("confidence") <= F.lit(max_confidence).cast("float"))
    return F.coalesce(out, F.lit(False))


def purge(scope: str, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """({table: rows of other scopes}, removed per table)."""
    gone = F.col("scope").eqNullSafe(F.lit(need_text(scope, "scope")))
    counts_ = None
    for name, df in tables.items():
        c = df.where(gone).agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n_removed"))
        counts_ = c if counts_ is None else counts_.unionByName(c)
    return {name: df.where(~gone) for name, df in tables.items()}, counts_


def scopes(memories: DataFrame) -> DataFrame:
    return memories.select("scope").distinct()


def reembed(rows: DataFrame, embed, text_col: str = "content", batch: int = 256) -> DataFrame:
    """Rows with vectors made anew by ``embed(list of texts) -> list of vectors``; an empty answer keeps the old one.

    Memories by their content, nodes by ``text_col="label"``.
    """
    columns = rows.columns

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch].copy()
                new = embed(part[text_col].fillna("").tolist())
                part["embedding"] = [n if n is not None and len(n) else o for n, o in zip(new, part["embedding"])]
                yield part[columns]

    return rows.mapInPandas(run, rows.schema)

"""Lexical relevance: what of a set of candidates speaks about a question, and whether anything does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text

FLOOR, HOP, TOP = 0.3, 0.5, 5
#: Candidates of a scope that are ranked at most; the rest counts as irrelevant.
MAX_CANDIDATES = 2_000
SOURCE_ORDER = {"graph": 0, "memory": 1, "material": 2}


def relevance(candidate: Column, questions: list[str], prefix: int = 0) -> Column:
    """The greatest share of a question's terms that the candidate has, over the ways the question was put."""
    c = text.terms(candidate, prefix)
    shares = [text.share(text.terms(F.lit(q), prefix), c) for q in questions]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def graph_candidates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scope, id, source, body, prior, head, tail: one candidate per different (source, relation, target), the first by edge id."""
    names = nodes.select("scope", "id", "label")
    rows = edges.select("scope", F.col("id").alias("edge_id"), "source_id", "target_id", "relation")
    for end in ("source", "target"):
        rows = rows.join(names.select("scope", F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label")), ["scope", f"{end}_id"])
    head, tail = (F.array_join(text.tokens(F.col(f"{e}_label")), " ") for e in ("source", "target"))
    w = Window.partitionBy("scope", F.lower("source_label"), "relation", F.lower("target_label")).orderBy("edge_id")
    rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    body = F.concat_ws(" ", "source_label", F.replace(F.col("relation"), F.lit("_"), F.lit(" ")), "target_label")
    return rows.select("scope", F.concat(F.lit("edge:"), F.col("edge_id").cast("string")).alias("id"), F.lit("graph").alias("source"), body.alias("body"), F.col("edge_id").alias("prior"), head.alias("head"), tail.alias("tail"))


def memory_candidates(memories: DataFrame) -> DataFrame:
    rows = memories.where(F.col("content").rlike("\\S"))
    # what was written first comes first: its time orders like its place, and needs no sort
    first = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62)))
    return rows.select("scope", F.concat(F.lit("memory:"), "id").alias("id"), F.lit("memory").alias("source"), F.col("content").alias("body"), first.alias("prior"), F.lit("").alias("head"), F.lit("").alias("tail"))


def rank(candidates: DataFrame, questions: list[str], prefix: int = 0, hop: float = HOP, most: int = MAX_CANDIDATES) -> DataFrame:
    """The first ``most`` candidates of each scope with score and place; the bound cuts before the shuffle.

    A graph candidate whose head is the tail of one that scores by itself gets ``hop`` times the best of those; one pass.
    """
    own = candidates.withColumn("own", relevance(F.col("body"), questions, prefix))
    best = own.where((F.col("source") == "graph") & (F.col("own") > 0) & (F.col("tail") != "")).groupBy("scope", F.col("tail").alias("head")).agg(F.max("own").alias("__best"))
    met = own.join(best, ["scope", "head"], "left")
    bonus = F.when((F.col("source") == "graph") & (F.col("head") != ""), F.coalesce(F.col("__best"), F.lit(0.0)) * hop).otherwise(0.0)
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_ORDER.items() for x in kv]), F.col("source")), F.lit(3))
    scored = met.withColumn("score", F.round(F.greatest("own", bonus), 6)).withColumn("__o", order)
    w = Window.partitionBy("scope").orderBy(F.col("score").desc(), "__o", "prior", "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("__best", "__o", "own")


def chosen(ranked: DataFrame, floor: float = FLOOR, top: int = TOP) -> DataFrame:
    return ranked.where((F.col("score") >= floor) & (F.col("score") > 0) & (F.col("place") <= top))


def decide(ranked: DataFrame, anchors: list[str], failed: bool = False, floor: float = FLOOR, top: int = TOP) -> DataFrame:
    """scope, decision, n_picked: relevant, error, partial or nothing_relevant per scope.

    Partial: a head or tail has an anchor's words side by side.
    """
    def has(end: str) -> Column:
        out = F.lit(False)
        for a in anchors:
            words = " ".join(text._py_tokens(a))
            if words:
                out = out | F.concat(F.lit(" "), F.col(end), F.lit(" ")).contains(f" {words} ")
        return out

    hit = (F.col("score") >= floor) & (F.col("score") > 0)
    part = has("head") | has("tail")
    rows = ranked.groupBy("scope").agg(F.count_if(hit).alias("__h"), F.count_if(part).alias("__p"))
    decision = F.when(F.col("__h") > 0, "relevant").when(F.lit(failed), "error").when(F.col("__p") > 0, "partial").otherwise("nothing_relevant")
    picked = F.when(F.col("__h") > 0, F.least("__h", F.lit(top))).when(F.lit(failed), 0).otherwise(F.least("__p", F.lit(top)))
    return rows.select("scope", decision.alias("decision"), picked.cast("bigint").alias("n_picked"))


CLIP = 600
#: Words by which someone speaks of themselves, in Portuguese and English (fixed values).
FIRST_PERSON = ("eu", "me", "mim", "comigo", "meu", "minha", "my", "mine", "myself")


def speaks_of_self(c: Column) -> Column:
    """Whether a text speaks of its writer: a word of ``FIRST_PERSON``, or an I that stands alone."""
    said = F.arrays_overlap(text.tokens(c), F.array(*(F.lit(w) for w in FIRST_PERSON)))
    return F.coalesce(said | text.fold(c).rlike(r"(?<![a-z0-9])i(?![a-z0-9])"), F.lit(False))


def variants(query: str, original: str | None) -> list[str]:
    """The question, and how it was first put if that adds a term."""
    mine = {t for t in text._py_tokens(query) if t not in text.STOPWORDS}
    other = {t for t in text._py_tokens(original or "") if t not in text.STOPWORDS}
    return [query, original] if original and other - mine else [query]


def anchor(label: str) -> str:
    """A label's words without function words at its ends."""
    words = text._py_tokens(label)
    while words and words[0] in text.STOPWORDS:
        words = words[1:]
    while words and words[-1] in text.STOPWORDS:
        words = words[:-1]
    return " ".join(words)


def partial(ranked: DataFrame, anchors: list[str], top: int = TOP) -> DataFrame:
    """scope, id, place: candidates that name an anchor at an end, then graph candidates that go on from one of those, ``top`` per scope."""
    words = [w for w in (anchor(a) for a in anchors) if w]
    hit = F.lit(False)
    for w in words:
        for end in ("head", "tail"):
            hit = hit | F.concat(F.lit(" "), F.col(end), F.lit(" ")).contains(f" {w} ")
    marked = ranked.withColumn("__hit", hit)
    ends = marked.where("__hit AND tail <> ''").select("scope", F.col("tail").alias("head"), F.lit(True).alias("__on")).distinct()
    met = marked.join(ends, ["scope", "head"], "left").where(F.col("__hit") | (F.coalesce("__on", F.lit(False)) & (F.col("source") == "graph")))
    w = Window.partitionBy("scope").orderBy(F.col("__hit").desc(), F.col("place"))
    return met.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).select("scope", "id", F.col("__n").alias("place"))


def render(picked: DataFrame, header: str) -> DataFrame:
    """scope, block: numbered lines of the picked candidates, each cut at a bound."""
    body = text.squeezed(F.col("body"))
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.when(F.length(body) > CLIP, F.concat(F.left(body, F.lit(CLIP - 1)), F.lit("…"))).otherwise(body))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return picked.groupBy("scope").agg(F.concat(F.lit(header + "\n"), F.array_join(lines, "\n")).alias("block"))

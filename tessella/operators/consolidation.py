"""Consolidation of turns into memories: edge-triggered rules, transcripts, tolerant reading of model replies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.ids import same_ids

#: Confidence of what each rule emits (fixed values).
STARTED, COMPLETED, ABANDONED, SENTIMENT, PII, PREFERENCE, FROM_MODEL = 0.9, 1.0, 0.85, 0.7, 1.0, 0.7, 0.8
BATCH = 10


def micro(turns: DataFrame) -> DataFrame:
    """id, category, detail, confidence: what each turn adds against the one before it in its session.

    A goal's start, completion or abandonment when goal or status changed; rising frustration; personal information kinds
    on every turn that has any; domains the turn before did not have.
    """
    w = Window.partitionBy("scope", "session_id").orderBy("turn_n", "id")
    g, s = F.coalesce("goal", F.lit("")), F.coalesce("goal_status", F.lit(""))
    mood = F.upper(F.coalesce("sentiment", F.lit("")))
    rows = same_ids(turns).select(
        "id", g.alias("g"), s.alias("s"), mood.alias("m"), F.coalesce("domains", F.array().cast("array<string>")).alias("d"), F.coalesce("pii_types", F.array().cast("array<string>")).alias("p"),
        F.lag(g).over(w).alias("pg"), F.lag(s).over(w).alias("ps"), F.lag(mood).over(w).alias("pm"), F.lag(F.coalesce("domains", F.array().cast("array<string>"))).over(w).alias("pd"),
    )
    up = F.upper("s")
    moved = (F.col("g") != "") & (F.col("s") != "") & (F.col("pg").isNull() | (F.col("pg") != F.col("g")) | (F.col("ps") != F.col("s")))

    def made(when, category, detail, confidence):
        return F.when(when, F.struct(F.lit(category).alias("category"), detail.alias("detail"), F.lit(confidence).alias("confidence")))

    fresh = F.filter("d", lambda x: x.isNotNull() & (x != "") & ~F.coalesce(F.array_contains(F.coalesce("pd", F.array().cast("array<string>")), x), F.lit(False)))
    kept = F.array_compact(
        F.array(
            made(moved & (up == "NEW"), "goal_started", F.col("g"), STARTED),
            made(moved & (up == "COMPLETED"), "goal_completed", F.col("g"), COMPLETED),
            made(moved & (up == "ABANDONED"), "goal_abandoned", F.col("g"), ABANDONED),
            made((F.col("m") == "FRUSTRATED") & ~F.coalesce(F.col("pm") == "FRUSTRATED", F.lit(False)), "sentiment", F.lit("frustrated"), SENTIMENT),
            made(F.size("p") > 0, "pii", F.array_join("p", ", "), PII),
        )
    )
    preferences = F.transform(fresh, lambda x: F.struct(F.lit("preference").alias("category"), x.alias("detail"), F.lit(PREFERENCE).alias("confidence")))
    return rows.select("id", F.explode(F.concat(kept, preferences)).alias("e")).select("id", "e.category", "e.detail", "e.confidence")


def last_liked(turns: DataFrame, n: int = BATCH) -> DataFrame:
    """The last ``n`` turns of each session that were not disliked."""
    w = Window.partitionBy("scope", "session_id").orderBy(F.col("turn_n").desc_nulls_last(), F.col("id").desc())
    return same_ids(turns).where(F.coalesce(F.col("feedback"), F.lit(0)) != -1).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def transcripts(turns: DataFrame) -> DataFrame:
    """scope, session_id, transcript of the given (bounded) turns of each session."""
    goal = F.when(F.coalesce("goal", F.lit("")) != "", F.concat(F.lit(" [goal: "), "goal", F.lit("]"))).otherwise("")
    domains = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    mood = F.when(F.coalesce("sentiment", F.lit("")) == "", "NEUTRAL").otherwise(F.col("sentiment"))
    line = F.concat(F.lit("Turn "), F.coalesce(F.col("turn_n").cast("string"), F.lit("?")), F.lit(": "), F.coalesce("user_input", F.lit("")), F.lit("\n  sentiment="), mood, F.lit(" domains="), domains, goal, F.lit("\n  assistant: "), F.coalesce("response", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn_n", "id", line.alias("line")))), lambda x: x["line"])
    return same_ids(turns).groupBy("scope", "session_id").agg(F.array_join(lines, "\n").alias("transcript"))


def sole_voice(turns: DataFrame) -> DataFrame:
    """scope, session_id, voice: the one voice of all turns, or empty when a turn has none or another."""
    v = F.trim(F.coalesce("voiced_by", F.lit("")))
    return same_ids(turns).groupBy("scope", "session_id").agg(F.min(v).alias("a"), F.max(v).alias("b")).select("scope", "session_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("").alias("voice"))


def parse_memories(replies: DataFrame, confidence: float = FROM_MODEL) -> DataFrame:
    """reply_id, category, content, confidence from replies (reply_id, raw): ``{category: [text, ...]}``, fenced or not.

    Anything else in a reply is passed over; an unreadable one gives nothing.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    parsed = F.from_json(bare, "map<string,string>")
    items = replies.select("reply_id", F.explode(parsed).alias("category", "items"))
    texts = F.explode(F.from_json("items", "array<string>")).alias("content")
    return items.where(F.col("items").startswith("[")).select("reply_id", "category", texts).where(F.col("content").rlike("\\S")).select("reply_id", "category", F.trim("content").alias("content"), F.lit(confidence).alias("confidence"))


def close_summary(turns: DataFrame) -> DataFrame:
    """scope, session_id, n_turns, n_disliked, domains: what the end of a session is summed up from."""
    return same_ids(turns).groupBy("scope", "session_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("feedback") == -1).alias("n_disliked"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("domains", F.array().cast("array<string>")))))), ",").alias("domains"),
    )


def periodic(turns: DataFrame, model, n: int = BATCH, confidence: float = FROM_MODEL) -> DataFrame:
    """scope, session_id, category, content, confidence, first_heard_by: memories a model draws from each session's last liked turns.

    ``model``: list of transcripts -> list of replies, called on Arrow batches where the rows are; a failing call gives no memory.
    """
    batch = last_liked(turns, n)
    texts = transcripts(batch).join(sole_voice(batch), ["scope", "session_id"])

    @F.pandas_udf("string")
    def reply(t: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(t.tolist()), dtype="object")
        except Exception:  # noqa: BLE001 - one bad batch must not end the job
            return pd.Series([None] * len(t), dtype="object")

    said = texts.select(F.struct("scope", "session_id", "voice").alias("reply_id"), reply("transcript").alias("raw"))
    return parse_memories(said, confidence).select("reply_id.scope", "reply_id.session_id", "category", "content", "confidence", F.col("reply_id.voice").alias("first_heard_by"))


def parse_relations(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: reply_id, label, node_type; edges: reply_id, source, target, relation, confidence) of model replies, tolerant of anything else."""
    from tessella.operators.graph import node_type

    bare = F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    schema = "nodes array<struct<label:string,type:string>>, edges array<struct<source:string,target:string,relation:string,confidence:string>>"
    parsed = replies.select("reply_id", F.from_json(bare, schema).alias("p"))
    nodes = parsed.select("reply_id", F.explode("p.nodes").alias("n")).where(F.coalesce("n.label", F.lit("")) != "")
    edges = parsed.select("reply_id", F.explode("p.edges").alias("e")).where((F.coalesce("e.source", F.lit("")) != "") & (F.coalesce("e.target", F.lit("")) != "") & (F.coalesce("e.relation", F.lit("")) != ""))
    return (
        nodes.select("reply_id", "n.label", node_type(F.coalesce("n.type", F.lit("CONCEPT"))).alias("node_type")),
        edges.select("reply_id", "e.source", "e.target", "e.relation", F.coalesce(F.expr("try_cast(e.confidence AS double)"), F.lit(1.0)).alias("confidence")),
    )

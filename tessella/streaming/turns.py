"""Structured Streaming twins of the stateful operators over turns.

Each has a batch operator that says what it must come to; state is bounded per key and falls with a time limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators import consolidation
from tessella.operators.buffer import MAX_SIZE, TTL_SECONDS

WINDOW_OUT = "scope string, session_id string, ids array<bigint>, last_at timestamp"


def window(turns: DataFrame, max_size: int = MAX_SIZE, ttl_seconds: int = TTL_SECONDS, watermark: str = "1 hour") -> DataFrame:
    """The short-term window of every session after each push: at most ``max_size`` turn ids, dropped after the lifetime.

    ``turns``: scope, session_id, id, created_at (timestamp).  Batch twin: ``operators.buffer``.
    """

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = state.get if state.exists else ([], 0)
        held = list(held)
        for f in frames:
            held = sorted(set(held) | set(f["id"].tolist()))[-max_size:]
            last = max(last, int(f["created_at"].max().timestamp() * 1000))
        state.update((held, last))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"scope": [key[0]], "session_id": [key[1]], "ids": [held], "last_at": [pd.Timestamp(last, unit="ms")]})

    return (
        turns.withWatermark("created_at", watermark)
        .groupBy("scope", "session_id")
        .applyInPandasWithState(push, WINDOW_OUT, "held array<bigint>, last_ms bigint", "update", GroupStateTimeout.EventTimeTimeout)
    )


def idle(turns: DataFrame, idle_seconds: int = 1800, watermark: str = "10 minutes") -> DataFrame:
    """Sessions that fell silent: one row per run of turns without a longer gap, once the watermark has passed it."""
    gap = F.session_window("created_at", f"{idle_seconds} seconds")
    return (
        turns.withWatermark("created_at", watermark)
        .groupBy("scope", "session_id", gap.alias("w"))
        .agg(F.count(F.lit(1)).alias("n_turns"), F.max("created_at").alias("last_at"))
        .select("scope", "session_id", F.col("w.start").alias("started_at"), "last_at", "n_turns")
    )


MICRO_OUT = "id bigint, category string, detail string, confidence double"


def micro(turns: DataFrame) -> DataFrame:
    """What each turn adds against the one before it, as it arrives in order.  State: the last turn.  Batch twin: ``consolidation.micro``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev = state.get if state.exists else None
        rows = []
        for t in pd.concat(list(frames)).sort_values(["turn_n", "id"]).itertuples():
            goal, status, mood = t.goal or "", t.goal_status or "", (t.sentiment or "").upper()
            domains = [x for x in (t.domains if t.domains is not None else []) if x]
            kinds = list(t.pii_types) if t.pii_types is not None else []
            if goal and status and (prev is None or prev[0] != goal or prev[1] != status):
                made = {"NEW": ("goal_started", consolidation.STARTED), "COMPLETED": ("goal_completed", consolidation.COMPLETED), "ABANDONED": ("goal_abandoned", consolidation.ABANDONED)}.get(status.upper())
                if made:
                    rows.append((t.id, made[0], goal, made[1]))
            if mood == "FRUSTRATED" and (prev is None or prev[2] != "FRUSTRATED"):
                rows.append((t.id, "sentiment", "frustrated", consolidation.SENTIMENT))
            if kinds:
                rows.append((t.id, "pii", ", ".join(kinds), consolidation.PII))
            rows += [(t.id, "preference", x, consolidation.PREFERENCE) for x in domains if prev is None or x not in prev[3]]
            prev = (goal, status, mood, domains)
        state.update(prev)
        yield pd.DataFrame(rows, columns=["id", "category", "detail", "confidence"])

    return turns.groupBy("scope", "session_id").applyInPandasWithState(step, MICRO_OUT, "goal string, goal_status string, mood string, domains array<string>", "append", GroupStateTimeout.NoTimeout)


def into_store(stream: DataFrame, merge, checkpoint: str):
    """Merge every micro-batch with ``merge(batch, number)``; exactly once if the merge is repeatable."""
    return stream.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(merge)

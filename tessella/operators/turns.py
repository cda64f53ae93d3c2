"""Turns and traces: writes with conflict rules, updates by key, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.ids import same_ids
from tessella.operators.guards import need_limit, need_text

TRACE_WINDOW_SECONDS = 3_600
KEY = ["scope", "session_id", "turn_n"]
LOSS_EVENTS = ("turn_conflict", "turn_allocation_exhausted", "trace_refused")


def save(stored: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, lost) of a batch of numbered turns: the first of a coordinate by ``id`` stays, later ones and stored coordinates are losses."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    ranked = same_ids(batch).withColumn("__n", place)
    if stored is not None:
        ranked = ranked.join(same_ids(stored).select(*KEY, F.lit(True).alias("__old")).distinct(), KEY, "left")
    else:
        ranked = ranked.withColumn("__old", F.lit(None).cast("boolean"))
    new = (F.col("__n") == 1) & F.col("__old").isNull()
    return ranked.where(new).drop("__n", "__old"), ranked.where(~new).drop("__n", "__old")


def allocate(turns: DataFrame) -> DataFrame:
    """Turns whose number is negative get the next numbers of their session in order of ``id``; the first number given is 1."""
    turns = same_ids(turns)
    free = F.coalesce(F.col("turn_n") < 0, F.lit(False))
    key = ["scope", "session_id"]
    numbered = turns.where(~free)
    # the greatest number is combined before the shuffle; only the rows without one are put in order
    top = numbered.groupBy(*key).agg(F.max("turn_n").alias("__top"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    new = turns.where(free).withColumn("__n", nth)
    t = top.select(*[F.col(k).alias(f"__{k}") for k in key], "__top")
    same = new["scope"].eqNullSafe(t["__scope"]) & new["session_id"].eqNullSafe(t["__session_id"])
    given = new.join(t, same, "left").withColumn("turn_n", (F.coalesce("__top", F.lit(0)) + F.col("__n")).cast("int"))
    return numbered.unionByName(given.select(*turns.columns))


def loss_counts(losses: DataFrame) -> DataFrame:
    """loss_event, n: counts over the closed set of events, zeros included."""
    rows = losses.groupBy("loss_event").agg(F.count(F.lit(1)).alias("n"))
    known = losses.sparkSession.createDataFrame([(e,) for e in LOSS_EVENTS], "loss_event string")
    return known.join(rows, "loss_event", "left").select("loss_event", F.coalesce("n", F.lit(0)).alias("n"))


def scope_digest(scope: Column) -> Column:
    return F.substring(F.sha2(scope, 256), 1, 12)


def masked(turns: DataFrame, only_flagged: bool = True) -> DataFrame:
    """Turns with personal numbers and addresses masked, where ``pii_types`` names any or everywhere."""
    due = F.coalesce(F.size("pii_types"), F.lit(0)) > 0 if only_flagged else F.lit(True)
    return turns.select(*[F.when(due, text.mask(F.col(c))).otherwise(F.col(c)).alias(c) if c in ("user_input", "response") else F.col(c) for c in turns.columns])


def update(turns: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Turns with ``column`` as in ``changes`` (scope, session_id, turn_n, seq, value); the last change of a coordinate wins."""
    turns = same_ids(turns)
    last = same_ids(changes).groupBy(*KEY).agg(F.max(F.struct("seq", "value")).alias("__c"))
    return turns.join(last, KEY, "left").withColumn(column, F.when(F.col("__c").isNotNull(), F.col("__c.value")).otherwise(F.col(column))).drop("__c")


def counts(turns: DataFrame) -> DataFrame:
    return same_ids(turns).groupBy("scope", "session_id").agg(F.count(F.lit(1)).alias("n_turns"))


def load(turns: DataFrame) -> DataFrame:
    """scope, session_id, turn_n, id, place: the turns of every session in order."""
    w = Window.partitionBy("scope", "session_id").orderBy("turn_n", "id")
    return same_ids(turns).select("scope", "session_id", "turn_n", "id", F.row_number().over(w).alias("place"))


def traces_of(traces: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored traces of sessions (``keys``: session_id, scope; a null or empty scope is any), in order of turn_n within each."""
    asked = same_ids(keys).select(F.col("session_id").alias("__i"), F.coalesce("scope", F.lit("")).alias("__s")).distinct()
    rows = revise_traces(traces)[0]
    w = Window.partitionBy("scope", "session_id").orderBy("turn_n", "created_at", "id")
    met = rows.join(asked, (rows["session_id"] == asked["__i"]) & ((asked["__s"] == "") | (asked["__s"] == rows["scope"])), "left_semi")
    return met.withColumn("place", F.row_number().over(w))


def recent(turns: DataFrame, limit: int = 5, exclude_session: str = "") -> DataFrame:
    """The newest turns of each scope across its sessions, equal times by greater id."""
    rows = same_ids(turns).where((F.lit(exclude_session) == "") | ~F.col("session_id").eqNullSafe(F.lit(exclude_session)))
    w = Window.partitionBy("scope").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= need_limit(limit)).select("scope", "id", "session_id", "turn_n", "place")


def page(turns: DataFrame, prefix: str, limit: int = 30, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(newest-first page of a subtree of scopes, total)."""
    rows = turns.where(text.in_subtree(F.col("scope"), need_text(prefix, "prefix")))
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).offset(offset).limit(need_limit(limit)), rows.agg(F.count(F.lit(1)).alias("total"))


def scopes(turns: DataFrame, prefix: str) -> DataFrame:
    return turns.where(text.in_subtree(F.col("scope"), need_text(prefix, "prefix"))).select("scope").distinct()


def revise_traces(traces: DataFrame, window_seconds: int = TRACE_WINDOW_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(stored, refused) after writing ``traces`` in order of ``id``.

    The first write of a coordinate is its anchor for ever; a later one replaces the content only if its time is no
    later than the anchor's plus the window.  Neither side needs a sequential pass: the anchor is the least id.
    """
    traces = same_ids(traces)
    anchor = traces.groupBy(*KEY).agg(F.min(F.struct("id", "created_at")).alias("__a"))
    met = traces.join(anchor.select(*[F.col(k).alias(f"__{k}") for k in KEY], "__a"), _same_key(traces), "left")
    fits = F.coalesce(F.col("created_at") <= F.col("__a.created_at") + F.make_interval(secs=F.lit(window_seconds)), F.lit(False)) | (F.col("id") == F.col("__a.id"))
    marked = met.withColumn("__fits", fits)
    kept = marked.where("__fits").groupBy(*KEY).agg(F.max(F.struct("id", "trace")).alias("__l"), F.first("__a").alias("__a"))
    stored = kept.select(*KEY, F.col("__a.id").alias("id"), F.col("__l.id").alias("content_id"), F.col("__l.trace").alias("trace"), F.col("__a.created_at").alias("created_at"))
    return stored, marked.where(~F.col("__fits")).select(*traces.columns)


def _same_key(df: DataFrame) -> Column:
    out = F.lit(True)
    for k in KEY:
        out = out & df[k].eqNullSafe(F.col(f"__{k}"))
    return out


def trace_page(traces: DataFrame, prefix: str, since: Column, limit: int = 1000, offset: int = 0) -> DataFrame:
    rows = traces.where(text.in_subtree(F.col("scope"), need_text(prefix, "prefix")) & (F.col("created_at") >= since))
    order = [F.col(c).desc_nulls_last() for c in ("created_at", "session_id", "turn_n", "id")]
    return rows.orderBy(*order).offset(offset).limit(need_limit(limit))

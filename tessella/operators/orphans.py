"""References to records that do not exist.

Keyed pending-orphan state, kept in a folder that all executors share and moved by increments.  Two keyed tables:

* ``parents`` - the parent index: live keys with the time they first existed;
* ``refs`` - references, those waiting for a parent (orphans) apart from those that rest on one.

A key's rows lie in one of ``buckets`` partitions.  ``Ledger.advance`` takes new references, arriving parents and
deleted keys: references probe the index, arrivals resolve the orphans that wait for them, deletions reopen what
rested on their keys.  It reads only the buckets of the keys that come, and of these the waiting rows only, unless a
parent is deleted or turns out to have existed earlier; it writes the increment and the waiting rows of these
buckets, never the history.  ``cases`` and ``snapshot`` read the open orphans at any time.

Defined cases: a null or blank reference never enters the state; a reference that cannot name any parent
(``ref_key`` null) waits for ever, in a bucket that no arrival touches; a null parent time counts as "always there";
repeated parents keep the earliest time; repeated rows of one reference stay apart by ``row_id``; empty inputs give
empty states; within an increment deletions come first, then arrivals, then references.  One key may hold a third of
all rows: joins go through ``lookup_join``, and writing splits large buckets over several tasks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.ids import is_blank, uuid_hex
from tessella.plans.durable import cut, shared_folder
from tessella.plans.skew import hot_keys, lookup_join

REF_SCHEMA = "tbl string, field_name string, row_id bigint, ref_kind string, ref_key string, ref_at timestamp_ntz, parent_at timestamp_ntz"
PARENT_SCHEMA = "ref_kind string, ref_key string, parent_at timestamp_ntz"
KEYS = ["ref_kind", "ref_key"]
#: Stands for the time of a parent that carries none: earlier than any reference.
ALWAYS = "0001-01-01 00:00:00"
#: Partitions of the keyed state.
BUCKETS = 32
#: The bucket of references that can name no parent.
NOWHERE = -1


def _always(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(ALWAYS).cast("timestamp_ntz"))


@dataclass
class Segments:
    """A table of immutable segments, each partitioned by ``parts``; a bucket that was written anew is dead in those before."""

    spark: SparkSession
    path: str
    schema: str
    parts: tuple[str, ...]
    segments: list[list] = field(default_factory=list)  # [folder, {partition values that are dead in it}]

    def read(self, **only: list) -> DataFrame:
        """The live rows, of the given partition values only."""
        out = None
        for folder, dead in self.segments:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
            for name, values in only.items():
                rows = rows.where(F.col(name).isin(values))
            if dead:
                gone = {v[:-1] for v in dead}
                for kind in sorted(gone):
                    rows = rows.where(~(F.lit(True) if not kind else F.col(self.parts[0]) == kind[0]) | ~F.col("bucket").isin([v[-1] for v in sorted(dead) if v[:-1] == kind]))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        folder = f"{len(self.segments):05d}-{uuid.uuid4().hex[:8]}"
        # adaptive execution splits a large bucket over several tasks and joins small ones
        rows.hint("rebalance", *self.parts).write.partitionBy(*self.parts).parquet(f"{self.path}/{folder}")
        self.segments.append([folder, set()])

    def replace(self, rows: DataFrame, keys: list[tuple]) -> None:
        """``rows`` are all there is now under these partition values."""
        before = len(self.segments)
        self.append(rows)
        for segment in self.segments[:before]:
            segment[1] |= set(keys)


class Ledger:
    """The pending-orphan state in a folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or shared_folder(spark, "orphans")
        self.parents = Segments(spark, f"{self.path}/parents", PARENT_SCHEMA + ", bucket int", ("bucket",))
        self.refs = Segments(spark, f"{self.path}/refs", REF_SCHEMA + ", resting boolean, bucket int", ("resting", "bucket"))

    # what a later session needs to go on

    def manifest(self) -> str:
        return json.dumps({"buckets": self.buckets, "tables": {n: [[f, sorted(d)] for f, d in getattr(self, n).segments] for n in ("parents", "refs")}})

    @classmethod
    def resume(cls, spark: SparkSession, path: str, manifest: str) -> "Ledger":
        kept = json.loads(manifest)
        out = cls(spark, path, kept["buckets"])
        for name, segments in kept["tables"].items():
            getattr(out, name).segments = [[f, {tuple(v) for v in d}] for f, d in segments]
        return out

    # increments

    def _keyed(self, rows: DataFrame) -> DataFrame:
        bucket = F.when(F.col("ref_key").isNull(), NOWHERE).otherwise(F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)))
        return rows.withColumn("bucket", bucket.cast("int"))

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows: at most ``buckets`` numbers."""
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect() if r["bucket"] != NOWHERE)

    def index(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.parents.read(**({} if buckets is None else {"bucket": buckets}))
        return rows.groupBy("bucket", *KEYS).agg(F.min("parent_at").alias("parent_at"))

    def advance(self, refs: DataFrame | None = None, parents: DataFrame | None = None, deleted: DataFrame | None = None) -> "Ledger":
        """One increment.  ``refs`` as REF_SCHEMA (parent_at ignored), ``parents`` as PARENT_SCHEMA, ``deleted``: ref_kind, ref_key."""
        if deleted is not None:
            self._delete(deleted)
        if parents is not None:
            self._arrive(parents)
        if refs is not None:
            self._refer(refs)
        return self

    def _delete(self, deleted: DataFrame) -> None:
        gone = self._keyed(deleted.where(F.col("ref_key").isNotNull()).select(*KEYS)).distinct()
        touched = self._touched(gone)
        if not touched:
            return
        self.parents.replace(self.index(touched).join(gone, ["bucket", *KEYS], "left_anti").select(*_columns(self.parents.schema)), [(b,) for b in touched])
        held = self.refs.read(resting=[True], bucket=touched)
        marked = lookup_join(held, gone.withColumn("__gone", F.lit(True)), ["bucket", *KEYS], "left", hot_keys(held, ["bucket", *KEYS]))
        reopened = F.col("__gone").isNotNull()
        new = marked.withColumn("parent_at", F.when(~reopened, F.col("parent_at"))).withColumn("resting", ~reopened)
        # what waits already stays as it is; what is reopened joins it
        self.refs.replace(new.select(*_columns(self.refs.schema)), [(True, b) for b in touched])

    def _arrive(self, parents: DataFrame) -> None:
        came = self._keyed(parents.where(F.col("ref_key").isNotNull()).select(*KEYS, _always("parent_at").alias("parent_at")))
        came = came.groupBy("bucket", *KEYS).agg(F.min("parent_at").alias("parent_at"))
        if self.parents.segments:
            known = self.index(self._touched(came)).withColumnRenamed("parent_at", "__was")
            news = came.join(known, ["bucket", *KEYS], "left").where(F.col("__was").isNull() | (F.col("parent_at") < F.col("__was")))
            news = cut(news.select("bucket", *KEYS, "parent_at", F.col("__was").isNotNull().alias("__moved")))
        else:
            news = cut(came.withColumn("__moved", F.lit(False)))
        self.parents.append(news.select(*_columns(self.parents.schema)))
        if not self.refs.segments:
            return
        # arrivals resolve what waits for them; parents that existed earlier than known move what rests on them
        for resting, changed in ((False, news), (True, news.where("__moved"))):
            touched = self._touched(changed)
            if not touched:
                continue
            held = self.refs.read(resting=[resting], bucket=touched)
            new = changed.select("bucket", *KEYS, F.col("parent_at").alias("__new"))
            met = lookup_join(held, new, ["bucket", *KEYS], "left", hot_keys(held, ["bucket", *KEYS]))
            met = met.withColumn("parent_at", F.coalesce("__new", "parent_at")).withColumn("resting", F.col("parent_at").isNotNull())
            self.refs.replace(met.select(*_columns(self.refs.schema)), [(resting, b) for b in touched])

    def _refer(self, refs: DataFrame) -> None:
        asked = self._keyed(refs.drop("parent_at"))
        able = asked.where(F.col("ref_key").isNotNull())
        lost = asked.where(F.col("ref_key").isNull()).withColumn("parent_at", F.lit(None).cast("timestamp_ntz"))
        met = lookup_join(able, self.index(self._touched(able)), ["bucket", *KEYS], "left", hot_keys(able, ["bucket", *KEYS]))
        rows = met.unionByName(lost).withColumn("resting", F.col("parent_at").isNotNull())
        self.refs.append(rows.select(*_columns(self.refs.schema)))

    # reading

    def cases(self) -> DataFrame:
        """tbl, field_name, period_ym, row_id, ref_state: open orphans (``missing``) and those whose parent came only after them (``late``)."""
        verdict = F.when(~F.col("resting"), "missing").when(F.col("parent_at") > F.col("ref_at"), "late")
        return (
            self.refs.read()
            .withColumn("ref_state", verdict)
            .where(F.col("ref_state").isNotNull())
            .select("tbl", "field_name", F.date_format("ref_at", "yyyy-MM").alias("period_ym"), "row_id", "ref_state")
        )

    def snapshot(self) -> DataFrame:
        """Counts of the open cases per table, field, period and state."""
        return self.cases().groupBy("tbl", "field_name", "period_ym", "ref_state").agg(F.count(F.lit(1)).alias("n_refs"))


def _columns(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


# ---- the references of the tables


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as references to nodes by id; null ends are none."""
    ends = F.explode(
        F.array(
            F.struct(F.lit("source_id").alias("field_name"), F.col("source_id").alias("ref")),
            F.struct(F.lit("target_id").alias("field_name"), F.col("target_id").alias("ref")),
        )
    )
    return (
        edges.select("id", "created_at", ends.alias("e"))
        .where(F.col("e.ref").isNotNull())
        .select(
            F.lit("knowledge_edges").alias("tbl"),
            F.col("e.field_name").alias("field_name"),
            F.col("id").alias("row_id"),
            F.lit("node").alias("ref_kind"),
            F.col("e.ref").cast("string").alias("ref_key"),
            F.col("created_at").cast("timestamp_ntz").alias("ref_at"),
            F.lit(None).cast("timestamp_ntz").alias("parent_at"),
        )
    )


def _session_key(scope: str, sid: str):
    return F.when(uuid_hex(F.col(sid)).isNotNull(), F.concat(uuid_hex(F.col(sid)), F.lit(" "), F.coalesce(F.col(scope), F.lit(""))))


def turn_references(turns: DataFrame) -> DataFrame:
    """session_id of every turn as a reference to sessions by scope and UUID; other text can name no session."""
    return turns.where(~is_blank(F.col("session_id"))).select(
        F.lit("turns").alias("tbl"),
        F.lit("session_id").alias("field_name"),
        F.col("id").alias("row_id"),
        F.lit("session").alias("ref_kind"),
        _session_key("scope", "session_id").alias("ref_key"),
        F.col("created_at").cast("timestamp_ntz").alias("ref_at"),
        F.lit(None).cast("timestamp_ntz").alias("parent_at"),
    )


def node_parents(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("ref_kind"), F.col("id").cast("string").alias("ref_key"), F.col("created_at").cast("timestamp_ntz").alias("parent_at"))


def session_parents(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.lit("session").alias("ref_kind"), _session_key("scope", "id").alias("ref_key"), F.col("started_at").cast("timestamp_ntz").alias("parent_at"))


#: Increments that a whole history is taken in.
STEPS = 3


def ledger(turns: DataFrame, edges: DataFrame, nodes: DataFrame, sessions: DataFrame, steps: int = STEPS, path: str | None = None) -> Ledger:
    """The state after the whole history of these tables, taken in ``steps`` increments in order of time, rows without a time first."""
    state = Ledger(turns.sparkSession, path)
    span = turns.select("created_at").unionByName(edges.select("created_at")).agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).first()
    bounds = [] if span.lo is None else [span.lo + (span.hi - span.lo) * k / steps for k in range(1, steps)]

    def within(df: DataFrame, at: str, k: int) -> DataFrame:
        rows = df
        if k < len(bounds):
            rows = rows.where(F.coalesce(F.col(at).cast("timestamp_ntz") < F.lit(bounds[k]).cast("timestamp_ntz"), F.lit(True)))
        if k:
            rows = rows.where(F.col(at).cast("timestamp_ntz") >= F.lit(bounds[k - 1]).cast("timestamp_ntz"))
        return rows

    for k in range(len(bounds) + 1):
        refs = edge_references(within(edges, "created_at", k)).unionByName(turn_references(within(turns, "created_at", k)))
        state.advance(refs, node_parents(within(nodes, "created_at", k)).unionByName(session_parents(within(sessions, "started_at", k))))
    return state

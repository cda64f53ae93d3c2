"""The pending-orphan ledger kept by a stream: every micro-batch is one increment.

The state lies in the ledger's buckets, not in the stream: it has no bound per key, is read by the keys that come, and a
hot key is no task of its own.  A batch that is tried again after a failure is not taken twice: the ledger's manifest
names the last one it has taken and is written with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.orphans import Ledger
from tessella.sources.snapshots import read_text, replace_text

#: An event is a reference, a parent's arrival or its deletion.
EVENTS = "tbl string, field_name string, ref_kind string, ref_key string, event string, row_id bigint, at timestamp"


def take(ledger: Ledger, batch: DataFrame, number: int) -> bool:
    """Moves the ledger by one batch of events, once: deletions, then arrivals, then references."""
    spark, pointer = ledger.spark, f"{ledger.path}/CURRENT"
    held = read_text(spark, pointer)
    if held is not None:
        done, manifest = held.split("\n", 1)
        if int(done) >= number:
            return False
        # what a failed try has left behind is not in the manifest
        again = Ledger.resume(spark, ledger.path, manifest)
        ledger.parents, ledger.refs = again.parents, again.refs
    at = F.col("at").cast("timestamp_ntz")
    of = lambda kind: batch.where(F.col("event") == kind)
    ledger.advance(
        of("reference").select("tbl", "field_name", "row_id", "ref_kind", "ref_key", at.alias("ref_at"), F.lit(None).cast("timestamp_ntz").alias("parent_at")),
        of("parent").select("ref_kind", "ref_key", at.alias("parent_at")),
        of("delete").select("ref_kind", "ref_key"),
    )
    replace_text(spark, pointer, f"{number}\n{ledger.manifest()}")
    return True


def follow(events: DataFrame, ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Starts keeping the ledger by a stream of ``EVENTS``; ``ledger.cases()`` and ``snapshot()`` can be read at any time."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            take(ledger, rows, number)
        finally:
            rows.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).start()

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import lifecycle as lc

T = datetime(2025, 1, 1)


def at(hours):
    return F.lit((T + timedelta(hours=hours)).isoformat(sep=" ")).cast("timestamp_ntz")


@pytest.fixture()
def ask(spark):
    return lambda *rows: spark.createDataFrame([("t1/a", d, s, "m", 10) for d, s in rows], "owner_key string, document_id string, sha256 string, embed_model string, size_bytes bigint")


@pytest.fixture()
def keys(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "document_id string, version int")


def states(lib):
    return {(r.document_id, r.version): r.state for r in lib.versions.collect()}


def stones(lib):
    return {(r.document_id, r.kind, tuple(r.versions)) for r in lib.tombstones.collect()}


def said(df):
    return {(r.document_id, r.version): r.outcome for r in df.collect()}


def drafts(spark, *rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "document_id string, version int, est_tokens bigint")


def test_a_version_is_served_and_older_ones_go(spark, ask, keys):
    lib = lc.begin(lc.Library.empty(spark), ask(("d", "h1")), at(0))
    lib, o = lc.commit(lib, keys(("d", 1)), at(1))
    assert said(o) == {("d", 1): "ready"} and states(lib) == {("d", 1): "ready"} and stones(lib) == set()
    assert states(lc.begin(lib, ask(("d", "h1")), at(2))) == {("d", 1): "ready"}  # the same again
    lib = lc.begin(lib, ask(("d", "h2"), ("d", "h3")), at(2))
    assert states(lib) == {("d", 1): "ready", ("d", 2): "processing", ("d", 3): "processing"}
    late, o = lc.commit(lib, keys(("d", 2)), at(3))
    assert said(o) == {("d", 2): "superseded"} and states(late) == {("d", 1): "ready", ("d", 3): "processing"}
    lib, o = lc.commit(lib, keys(("d", 3), ("x", 1), ("d", 9)), at(3))
    assert said(o) == {("d", 3): "ready", ("x", 1): "deleted", ("d", 9): "superseded"}
    assert states(lib) == {("d", 3): "ready"} and stones(lib) == {("d", "superseded", (1, 2))}
    r = lc.listed(lib).first()
    assert (r.active_version, r.latest_version, r.status) == (3, 3, "ready")


def test_drafts(spark, ask, keys):
    lib = lc.begin(lc.Library.empty(spark), ask(("d", "h"), ("e", "h"), ("f", "h")), at(0))
    lib = lc.park(lib, drafts(spark, ("d", 1), ("e", 1)), at(0))
    got, o = lc.claim(lib, keys(("d", 1), ("f", 1), ("z", 1)), at(23))
    assert said(o) == {("d", 1): "claimed", ("f", 1): "missing", ("z", 1): "missing"} and states(got)[("d", 1)] == "processing"
    assert said(lc.claim(lib, keys(("d", 1)), at(24))[1]) == {("d", 1): "expired"}
    assert states(lc.expire(lib, at(24))) == {("d", 1): "error", ("e", 1): "error", ("f", 1): "processing"}
    assert states(lc.expire(lib, at(24), limit=1)) == {("d", 1): "error", ("e", 1): "awaiting_confirmation", ("f", 1): "processing"}
    got, o = lc.discard(lib, keys(("d", 1), ("f", 1), ("z", 1)), at(1))
    assert said(o) == {("d", 1): "discarded", ("f", 1): "not_a_draft", ("z", 1): "missing"} and stones(got) == {("d", "discarded", (1,))}


def test_failures_and_removals(spark, ask, keys):
    lib = lc.begin(lc.Library.empty(spark), ask(("d", "h"), ("e", "h")), at(0))
    lib, _ = lc.commit(lib, keys(("e", 1)), at(0))
    bad = spark.createDataFrame([("d", 1, "invalid"), ("e", 1, "invalid")], "document_id string, version int, reason string")
    failed = lc.fail(lib, bad, at(1))
    assert states(failed) == {("d", 1): "error", ("e", 1): "ready"} and stones(failed) == {("d", "failed", (1,))}
    assert states(lc.begin(failed, ask(("d", "h")), at(2)))[("d", 1)] == "processing"
    assert states(lc.interrupt(lib, at(1)))[("d", 1)] == "error" and states(lc.interrupt(lib, at(0)))[("d", 1)] == "processing"
    gone = lc.delete(lib, keys(("e", 1)), at(1))
    assert states(gone) == {("d", 1): "processing"} and stones(gone) == {("e", "deleted", (1,))}
    assert states(lc.purge_subtree(lib, "t1", at(1))) == {} and len(states(lc.purge_subtree(lib, "t10", at(1)))) == 2
    assert lc.stored_bytes(lib, "t1").first().stored_bytes == 20 and lc.stored_bytes(lib, "t").first().stored_bytes == 0
    assert lc.tombstones(gone, "t1").count() == 1 and lc.prune_tombstones(gone, at(2)).tombstones.count() == 0

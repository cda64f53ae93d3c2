import json
from datetime import datetime, timedelta

from tessella.operators import consolidation, memories
from tessella.operators.orphans import Ledger
from tessella.sources.snapshots import Snapshots, markdown_files, turns_from_json, turns_to_json
from tessella.streaming import orphans as stream_orphans
from tessella.streaming import turns as stream_turns

T = datetime(2025, 1, 1)


def feed(spark, tmp_path, schema, batches):
    """A file stream of the given batches, one a trigger."""
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def drain(stream, name, mode, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name).collect()


def test_micro_stream_is_the_batch(spark, tmp_path):
    schema = "id bigint, scope string, session_id string, turn_n int, goal string, goal_status string, sentiment string, domains array<string>, pii_types array<string>"
    rows = [(1, "s", "a", 0, "g", "NEW", "FRUSTRATED", ["x"], []), (2, "s", "a", 1, "g", "ONGOING", "FRUSTRATED", ["x", "y"], ["email"]), (3, "s", "a", 2, "g", "COMPLETED", None, None, None), (4, "s", "b", 0, "", "", "frustrated", [], ["phone", "name"])]
    got = drain(stream_turns.micro(feed(spark, tmp_path, schema, [rows])), "micro", "append", tmp_path)
    assert {tuple(r) for r in got} == {tuple(r) for r in consolidation.micro(spark.createDataFrame(rows, schema)).collect()}


def test_window_stream_is_bounded(spark, tmp_path):
    schema = "scope string, session_id string, id bigint, created_at timestamp"
    rows = [("s", "a", i, T + timedelta(minutes=i)) for i in range(12)]
    got = drain(stream_turns.window(feed(spark, tmp_path, schema, [rows]), max_size=5), "win", "update", tmp_path)
    assert [r.ids for r in got] == [[7, 8, 9, 10, 11]]


def test_orphan_stream(spark, tmp_path):
    one = [("e", "f", "n", "k", "reference", 1, T), ("e", "f", "n", "z", "reference", 3, T)]
    two = [("", "", "n", "k", "parent", None, T + timedelta(1)), ("e", "f", "n", "k", "reference", 2, T + timedelta(2))]
    three = [("", "", "n", "k", "delete", None, T + timedelta(3))]
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    seen = []
    for upto in (1, 2, 3):
        feed(spark, tmp_path, stream_orphans.EVENTS, [(one, two, three)[upto - 1]])
        events = spark.readStream.schema(stream_orphans.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_orphans.follow(events, ledger, str(tmp_path / "cp"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        seen.append(sorted((r.row_id, r.ref_state) for r in ledger.cases().collect()))
    assert seen == [[(1, "missing"), (3, "missing")], [(1, "late"), (3, "missing")], [(1, "missing"), (2, "missing"), (3, "missing")]]
    # a batch that comes again is not taken again
    again = spark.createDataFrame(one, stream_orphans.EVENTS)
    assert not stream_orphans.take(ledger, again, 0) and ledger.refs.read().count() == 3


def test_snapshots_merge_and_swap(spark, tmp_path):
    schema = "id string, scope string, category string, content string, confidence float, feedback_score float, first_heard_by string, embedding array<float>, created_at timestamp_ntz"
    store = Snapshots(spark, str(tmp_path / "mem"), bucket_by="scope", buckets=16)
    assert store.read() is None and store.current() is None
    rule = lambda old, new: memories.save(new, old).drop("n_writes").select(*new.columns)
    store.merge(spark.createDataFrame([("a", "s", "c", "x", 0.5, 1.0, "v", [1.0], T)], schema), rule)
    first = store.current()
    store.merge(spark.createDataFrame([("b", "s", "c", "x", 0.75, 0.0, "w", None, T), ("c", "t", "c", "x", 0.5, 0.0, "w", None, T)], schema), rule)
    assert store.current() != first
    assert sorted((r.id, r.scope, r.confidence, r.feedback_score, r.first_heard_by, r.embedding) for r in store.read().collect()) == [("a", "s", 0.75, 1.0, "v", [1.0]), ("c", "t", 0.5, 0.0, "w", None)]
    assert store.vacuum() == 1 and store.read().count() == 2
    # a merge leaves the folders of other buckets as they are
    before = json.loads(store.current())["folders"]
    store.merge(spark.createDataFrame([("d", "t", "c", "y", 0.5, 0.0, "w", None, T)], schema), rule)
    after = json.loads(store.current())["folders"]
    assert len(before) == 2 and sum(before[b] == after[b] for b in before) == 1 and store.read().count() == 3


def test_json_lines_round_trip(spark):
    schema = "scope string, session_id string, turn_n int, user_input string, domains array<string>"
    df = spark.createDataFrame([("s", "a", 0, 'he said "x"\n', ["d"]), ("s", "a", None, None, None)], schema)
    assert sorted(map(str, turns_from_json(turns_to_json(df), schema).collect())) == sorted(map(str, df.collect()))


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿# A\x00".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe\xfa")
    got = {r.path[-4:]: (r.text, r.reason) for r in markdown_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# A", None), "b.md": (None, "invalid")}

import glob
import os
from datetime import datetime

from tessella.operators import orphans
from tessella.operators.orphans import PARENT_SCHEMA, REF_SCHEMA, Ledger
from tessella.plans import skew

T = [datetime(2025, m, 1) for m in range(1, 13)]


def refs(spark, *rows):
    return spark.createDataFrame([("edges", "source_id", i, "node", k, at, None) for i, k, at in rows], REF_SCHEMA)


def parents(spark, *rows):
    return spark.createDataFrame([("node", k, at) for k, at in rows], PARENT_SCHEMA)


def keys(spark, *ks):
    return spark.createDataFrame([("node", k) for k in ks], "ref_kind string, ref_key string")


def open_cases(state):
    rows = [(r.row_id, r.ref_state, r.period_ym) for r in state.cases().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_increments_give_what_one_step_gives(spark):
    r = [(1, "a", T[0]), (2, "b", T[1]), (3, "a", T[5]), (4, "c", T[2]), (5, None, T[3]), (6, "d", T[4])]
    p = [("a", T[3]), ("b", T[0]), ("d", None), ("a", T[4])]
    whole = Ledger(spark).advance(refs(spark, *r), parents(spark, *p))
    state = Ledger(spark)
    for i in range(0, 6, 2):
        state.advance(refs(spark, *r[i : i + 2]), parents(spark, *p[i : i + 2]) if i < 4 else None)
    assert open_cases(whole) == open_cases(state) == {(1, "late", "2025-01"), (4, "missing", "2025-03"), (5, "missing", "2025-04")}


def test_arrival_resolves_and_deletion_reopens(spark):
    state = Ledger(spark).advance(refs(spark, (1, "a", T[5]), (2, "b", T[5]), (3, "a", T[0])))
    assert open_cases(state) == {(1, "missing", "2025-06"), (2, "missing", "2025-06"), (3, "missing", "2025-01")}
    state.advance(parents=parents(spark, ("a", T[3])))
    assert open_cases(state) == {(2, "missing", "2025-06"), (3, "late", "2025-01")}
    # the parent turns out to have been there before
    state.advance(parents=parents(spark, ("a", None), ("a", T[7])))
    assert open_cases(state) == {(2, "missing", "2025-06")}
    state.advance(deleted=keys(spark, "a", "zz"))
    assert open_cases(state) == {(1, "missing", "2025-06"), (2, "missing", "2025-06"), (3, "missing", "2025-01")}
    assert {(r.period_ym, r.n_refs) for r in state.snapshot().collect()} == {("2025-06", 2), ("2025-01", 1)}
    # deleted and come again in one increment
    state.advance(refs(spark, (4, "a", T[2])), parents(spark, ("a", T[1])), keys(spark, "a"))
    assert open_cases(state) == {(2, "missing", "2025-06"), (3, "late", "2025-01")}


def test_random_histories_against_a_plain_version(spark):
    import random

    rng = random.Random(7)
    state, live, held, n = Ledger(spark, buckets=5), {}, [], 0
    for _ in range(5):
        gone = rng.sample("abcdefgh", 2)
        came = [(rng.choice("abcdefgh"), rng.choice([None, *T])) for _ in range(3)]
        new = [(n + i, rng.choice([*"abcdefgh", None]), rng.choice(T)) for i in range(4)]
        n += 4
        for k in gone:
            live.pop(k, None)
        for k, at in came:
            live[k] = min(live.get(k, datetime.max), at or datetime.min)
        held += new
        state.advance(refs(spark, *new), parents(spark, *came), keys(spark, *gone))
    want = {(i, "missing" if k not in live else "late", f"{at:%Y-%m}") for i, k, at in held if k not in live or live[k] > at}
    assert open_cases(state) == want


def test_an_increment_touches_only_the_buckets_of_its_keys(spark, tmp_path):
    state = Ledger(spark, str(tmp_path), buckets=16)
    state.advance(refs(spark, *((i, f"k{i}", T[1]) for i in range(64))), parents(spark, *((f"k{i}", T[0]) for i in range(0, 64, 2))))
    before = set(glob.glob(f"{tmp_path}/**/*.parquet", recursive=True))
    (touched,) = state._touched(state._keyed(keys(spark, "k1")))
    plan = state.refs.read(bucket=[touched])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    state.advance(parents=parents(spark, ("k1", T[0])))
    new = set(glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)) - before
    assert new and all(f"bucket={touched}{os.sep}" in f for f in new)
    assert before <= set(glob.glob(f"{tmp_path}/**/*.parquet", recursive=True))
    assert (1, "missing", "2025-02") not in open_cases(state) and (3, "missing", "2025-02") in open_cases(state)


def test_state_is_resumed(spark, tmp_path):
    state = Ledger(spark, str(tmp_path)).advance(refs(spark, (1, "a", T[5]), (2, "b", T[5])), parents(spark, ("b", T[0]))).advance(parents=parents(spark, ("a", T[6])))
    again = Ledger.resume(spark, str(tmp_path), state.manifest())
    assert open_cases(again) == open_cases(state) == {(1, "late", "2025-06")}
    assert open_cases(again.advance(deleted=keys(spark, "b"))) == {(1, "late", "2025-06"), (2, "missing", "2025-06")}


def test_empty(spark):
    assert open_cases(Ledger(spark).advance(refs(spark), parents(spark), keys(spark))) == set()
    assert open_cases(Ledger(spark)) == set()


def test_hot_key_takes_the_other_way(spark, monkeypatch):
    r = [(i, "hot" if i % 3 else f"k{i}", T[2]) for i in range(300)]
    p = [("hot", T[0])] + [(f"k{i}", T[6]) for i in range(0, 300, 6)]
    plain = open_cases(Ledger(spark).advance(refs(spark, *r), parents(spark, *p)))
    hot = skew.hot_keys(refs(spark, *r), ["ref_key"], floor=50)
    assert [x.ref_key for x in hot.collect()] == ["hot"]
    monkeypatch.setattr(orphans, "hot_keys", lambda df, ks: skew.hot_keys(df, ks, floor=50))
    assert open_cases(Ledger(spark).advance(refs(spark, *r)).advance(parents=parents(spark, *p))) == plain


def test_odd_rows_of_the_tables(spark):
    turns = spark.createDataFrame(
        [(1, "s", "A1B2C3D4-0000-4000-8000-000000000001", T[0], "x"), (2, "s", " ", T[0], "x"), (3, "s", None, T[0], "x"), (4, "s", "#no", None, "x"), (5, None, "a1b2c3d400004000800000000000000f", T[0], "x")],
        "id bigint, scope string, session_id string, created_at timestamp_ntz, ref_key string",
    )
    sess = spark.createDataFrame([("a1b2c3d4000040008000000000000001", "s", T[1], "x")], "id string, scope string, started_at timestamp_ntz, parent_at string")
    edges = spark.createDataFrame([(9, 1, None, T[0])], "id bigint, source_id bigint, target_id bigint, created_at timestamp_ntz")
    nodes = spark.createDataFrame([(1, None)], "id bigint, created_at timestamp_ntz")
    for steps in (1, 3):
        got = {(r.tbl, r.row_id, r.ref_state) for r in orphans.ledger(turns, edges, nodes, sess, steps).cases().collect()}
        assert got == {("turns", 1, "late"), ("turns", 4, "missing"), ("turns", 5, "missing")}

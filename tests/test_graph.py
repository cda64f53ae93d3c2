from collections import deque
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessella.operators import graph, turns
from tessella.operators.guards import need_status, need_text

EDGE = "id bigint, scope string, source_id bigint, target_id bigint, relation string, confidence double, source_session string, attributes map<string,string>, status string, audience string, created_at timestamp_ntz"


def edges(spark, rows):
    return spark.createDataFrame([(i, "s", a, b, "R", c, "", {}, st_, au, datetime(2025, 1, 1)) for i, a, b, c, st_, au in rows], EDGE)


def test_walk_matches_breadth_first_search(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.randrange(12), rng.randrange(12), 1.0, rng.choice(["accepted", "accepted", "proposed"]), rng.choice(["tenant", "identity:1", "identity:2", ""])) for i in range(40)]
    live = [(i, a, b) for i, a, b, _, s, au in rows if s == "accepted" and au in ("tenant", "identity:1")]
    starts = spark.createDataFrame([("s", k) for k in range(12)], "scope string, start_id bigint")
    for depth in (1, 2, 3):
        want = set()
        for start in range(12):
            dist, todo = {start: 0}, deque([start])
            while todo:
                x = todo.popleft()
                for _, a, b in live:
                    for p, q in ((a, b), (b, a)):
                        if p == x and q not in dist:
                            dist[q] = dist[x] + 1
                            todo.append(q)
            for i, a, b in live:
                k = min(dist.get(a, 99), dist.get(b, 99))
                if k < depth:
                    want.add((start, i, k + 1))
        got = {(r.start_id, r.edge_id, r.depth) for r in graph.walk(edges(spark, rows), starts, "identity:1", depth).collect()}
        assert got == want


def fold(writes):
    status = audience = ""
    conf, n = None, 0
    for s, a, c in writes:
        if status == "accepted" and s == "proposed":
            continue
        status = status if status in ("accepted", "rejected") else s
        audience = audience or a
        conf = c if conf is None else conf if c is None else max(conf, c)
        n += 1
    return status, audience, conf, n


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["accepted", "proposed", "rejected"]), st.sampled_from(["", "tenant", "identity:1"]), st.sampled_from([None, 0.1, 0.5, 0.9])), min_size=1, max_size=8))
def test_edge_merge_is_an_ordered_fold(spark, writes):
    rows = [(i, 1, 2, c, s, a) for i, (s, a, c) in enumerate(writes)]
    r = graph.upsert_edges(edges(spark, rows)).collect()
    assert [(x.status, x.audience, x.confidence, x.n_applied) for x in r] == [fold(writes)]


def test_audience(spark):
    rows = [(1, 1, 2, 1.0, None, "tenant"), (2, 1, 2, 1.0, "", "identity:1"), (3, 1, 2, 1.0, "maybe", "identity:2"), (4, 1, 2, 1.0, "rejected", None), (5, 1, 2, 1.0, "accepted", "identity:")]
    e = edges(spark, rows)
    see = lambda who: sorted(r.id for r in graph.visible_edges(e, who, accepted_only=False).collect())
    assert see("identity:1") == [1, 2] and see(graph.STAFF) == [1, 2, 3, 4, 5] and see("") == [1]


def test_context_stops_at_the_budget(spark):
    lines = spark.createDataFrame([("s", 1, i, 1, "x" * 40) for i in range(10)], "scope string, start_id bigint, edge_id bigint, depth int, line string")
    text = graph.context(lines, header="[H]", max_chars=130).first().context
    assert text == "\n".join(["[H]", "x" * 40, "x" * 40, "x" * 40])


def test_guards():
    with pytest.raises(ValueError):
        need_text(" ", "scope")
    with pytest.raises(ValueError):
        need_status("maybe")


def test_trace_window(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(1, "s", "x", 0, "a", t0), (2, "s", "x", 0, "b", datetime(2025, 1, 1, 1)), (3, "s", "x", 0, "c", datetime(2025, 1, 1, 1, 0, 1)), (4, "s", "x", 0, "d", datetime(2024, 1, 1)), (5, "s", None, None, "e", None)]
    df = spark.createDataFrame(rows, "id bigint, scope string, session_id string, turn_n int, trace string, created_at timestamp_ntz")
    stored, refused = turns.revise_traces(df)
    assert {(r.id, r.trace, r.created_at) for r in stored.collect()} == {(1, "d", t0), (5, "e", None)}
    assert [r.id for r in refused.collect()] == [3]

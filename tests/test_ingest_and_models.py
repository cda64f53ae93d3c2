import pytest

from tessella.operators import consolidation, ingest, lexical, rerank
from tessella.operators.chunking import ChunkConfig

TURN = "scope string, session_id string, id bigint, turn_n int, user_input string, response string, goal string, sentiment string, domains array<string>, feedback int, voiced_by string"


def test_prepare_and_embed(spark):
    docs = spark.createDataFrame([("a", 1, "T", "# H\nhello world\n\nbye"), ("b", 1, "T", ""), ("c", 2, "T", None), ("d", 1, "T", "x" * 500), ("e", 1, "", "\n\n".join(["y" * 45] * 9))], "document_id string, version int, title string, text string")
    chunks, outcomes = ingest.prepare(docs, ChunkConfig(50, 0, 4), max_bytes=450)
    assert {(r.document_id, r.version): (r.outcome, r.n_chunks) for r in outcomes.collect()} == {("a", 1): ("ready_to_embed", 1), ("b", 1): ("empty", 0), ("c", 2): ("empty", 0), ("d", 1): ("too_large", 0), ("e", 1): ("over_limit", 0)}
    got = ingest.embed(chunks, ingest.hashing_embedder(8), "m-8", 8).collect()
    assert [(r.document_id, r.heading_path, r.content, r.embed_model, round(sum(x * x for x in r.embedding), 3)) for r in got] == [("a", ["T", "H"], "T › H\n\nhello world\n\nbye", "m-8", 1.0)]
    with pytest.raises(Exception, match="8 numbers"):
        ingest.embed(chunks, ingest.hashing_embedder(8), "m-9", 9).collect()


def test_token_bucket():
    now, slept = [0.0], []
    b = ingest.TokensPerMinute(60, lambda: now[0], slept.append)
    assert b.take(60) == 0 and b.take(30) == 30 and slept == [30]
    now[0] = 90.0
    assert b.take(500) == 0
    with pytest.raises(ValueError):
        ingest.TokensPerMinute(0)


def test_a_batch_is_paced_like_single_requests(spark):
    asked = [20, 30, 40, 0, 500, 10, 60]
    df = spark.createDataFrame(list(enumerate(asked)), "n int, tokens int")
    now = [0.0]

    def sleep(s):
        now[0] += s

    b = ingest.TokensPerMinute(60, lambda: now[0], sleep)
    want = []
    for t in asked:
        b.take(t)
        want.append(now[0])
    assert [r.starts_at for r in ingest.paced(df, 60).orderBy("n").collect()] == want


def test_periodic_consolidation(spark):
    rows = [("s", "a", i, i, f"u{i}", "r", "", "", ["d"], -1 if i == 0 else 0, "v") for i in range(12)]
    df = spark.createDataFrame(rows + [("s", "b", 90, 0, "x", "y", "g", "SAD", None, None, None)], TURN)

    def model(texts):
        return ['```json\n{"fact": ["n=%d", " ", 3], "odd": "x"}\n```' % t.count("assistant:") if "u1" in t else "not json" for t in texts]

    got = [tuple(r) for r in consolidation.periodic(df, model).collect()]
    assert ("s", "a", "fact", "n=10", 0.8, "v") in got and all(g[1] == "a" for g in got)


def test_relations_are_read_tolerantly(spark):
    df = spark.createDataFrame([(1, '{"nodes":[{"label":"Ana","type":"person"},{"label":""},{"label":"Zig","type":"odd"}],"edges":[{"source":"Ana","target":"Zig","relation":"OWNS","confidence":"high"},{"source":"Ana"}]}'), (2, "nope"), (3, None)], "reply_id int, raw string")
    nodes, edges = consolidation.parse_relations(df)
    assert {(r.label, r.node_type) for r in nodes.collect()} == {("Ana", "PERSON"), ("Zig", "CONCEPT")}
    assert [tuple(r) for r in edges.collect()] == [(1, "Ana", "Zig", "OWNS", 1.0)]


def test_lexical_helpers(spark):
    assert lexical.variants("aula de cerâmica", "a aula") == ["aula de cerâmica"] and len(lexical.variants("aula", "forno")) == 2
    assert lexical.anchor("a casa da Maria") == "casa da maria"
    rows = [("s", "e1", "graph", "b1", 1, "maria", "rex", 0.0, 3), ("s", "e2", "graph", "b2", 2, "rex", "bola", 0.0, 4), ("s", "e3", "graph", "b" * 700, 3, "ana", "lua", 0.2, 1), ("s", "m", "memory", "b4", 1, "", "", 0.1, 2)]
    r = spark.createDataFrame(rows, "scope string, id string, source string, body string, prior bigint, head string, tail string, score double, place int")
    assert [(x.id, x.place) for x in lexical.partial(r, ["a Maria"]).orderBy("place").collect()] == [("e1", 1), ("e2", 2)]
    block = lexical.render(r.where("place <= 2"), "Q").first().block
    assert block.startswith("Q\n[e3] bbb") and block.endswith("…\n[m] b4")


def test_second_pass(spark):
    r = spark.createDataFrame([("q", i, "ask", "x" * (i % 3), i) for i in range(1, 30)], "query_id string, id int, query_text string, content string, new_place int")
    got = rerank.second_pass(r, lambda qs, cs: [float(len(c)) for c in cs], 3)
    assert [x.id for x in got.orderBy("final_place").collect()] == [2, 5, 8]

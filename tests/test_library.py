"""From bytes to served chunks: drafts, gates, commits, versions, contents; curation of edges by coordinate."""

from datetime import datetime

from pyspark.sql import functions as F

from tessella.operators import contents, graph, ingest, lexical, lifecycle, memories, sessions, turns
from tessella.operators.chunking import ChunkConfig



def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")

T = datetime(2025, 1, 1)
DOCS = "owner_key string, document_id string, title string, data binary"


def outcomes(df):
    return {(r.document_id, r.version): r.outcome for r in df.collect()}


def test_ingest_to_served_chunks(spark):
    c = ChunkConfig(60, 0.1, 4)
    docs = spark.createDataFrame([("o/a", "d1", "T", b"# H\nhello world"), ("o/a", "d2", "T", b" \n"), ("o/b", "d3", "T", b"\n\n".join(b"y" * 50 for _ in range(9))), ("o/b", "d4", "U", b"# K\n" + b"word " * 30)], DOCS)
    shelf, said = ingest.draft(ingest.Shelf.empty(spark), docs, "m-8", now(), c)
    assert outcomes(said) == {("d1", 1): "awaiting_confirmation", ("d2", 1): "empty", ("d3", 1): "over_limit", ("d4", 1): "awaiting_confirmation"}
    assert {(r.document_id, r.n_chunks) for r in contents.pending(shelf.drafts, shelf.lib, "o/a").collect()} == {("d1", 1)}
    assert {r.document_id for r in shelf.originals.collect()} == {"d1", "d4"}
    keys = said.select("document_id", "version")
    # a gate by size refuses the larger one
    gated, done = ingest.commit(shelf, keys, "m-8", 8, ingest.hashing_embedder(8), now(), F.col("est_tokens") < 20)
    assert outcomes(done) == {("d1", 1): "ready", ("d2", 1): "not_prepared", ("d3", 1): "not_prepared", ("d4", 1): "gate_refused"}
    assert [(r.document_id, r.content, r.embed_model, len(r.embedding)) for r in gated.chunks.collect()] == [("d1", "T › H\n\nhello world", "m-8", 8)]
    gated = gated.durable()
    # the same content again is unchanged; other content is a new version and supersedes
    same, said = ingest.ingest(gated, docs.where("document_id = 'd1'"), "m-8", 8, ingest.hashing_embedder(8), now(), None, c)
    assert outcomes(said) == {("d1", 1): "unchanged"}
    new = spark.createDataFrame([("o/a", "d1", "T", b"# H\nother text")], DOCS)
    after, said = ingest.ingest(gated, new, "m-8", 8, ingest.hashing_embedder(8), now(), None, c)
    assert outcomes(said) == {("d1", 2): "ready"}
    assert {(r.document_id, r.version, r.content) for r in after.chunks.collect()} == {("d1", 2, "T › H\n\nother text")}
    assert [(r.kind, list(r.versions)) for r in after.lib.tombstones.where("document_id = 'd1'").collect()] == [("superseded", [1])]
    # vectors of another width end the version
    bad, said = ingest.ingest(gated, new, "m-8", 9, ingest.hashing_embedder(8), now(), None, c)
    assert outcomes(said) == {("d1", 2): "bad_vector"} and {r.version for r in bad.chunks.collect()} == {1}
    again, said = ingest.reindex(gated, spark.createDataFrame([("d1",), ("d2",)], "document_id string"), docs, "n-4", 4, ingest.hashing_embedder(4), now(), c)
    assert outcomes(said) == {("d1", 2): "ready", ("d2", None): "no_original"} and {(r.embed_model, len(r.embedding)) for r in again.chunks.collect()} == {("n-4", 4)}
    assert set(contents.probe(gated.lib, gated.originals, gated.chunks, gated.drafts).values()) == {0}
    assert contents.stored_bytes(gated.originals, gated.lib, "o").first().stored_bytes == len(b"# H\nhello world")


def test_text_of_versions(spark):
    shelf = ingest.Shelf.empty(spark)
    lib = lifecycle.begin(shelf.lib, spark.createDataFrame([("o", "d", "s1", "m", 1), ("o", "d", "s2", "m", 1)], "owner_key string, document_id string, sha256 string, embed_model string, size_bytes bigint"), now())
    rows = spark.createDataFrame([("d", 2, k, ["T"], k // 2, f"c{k}") for k in range(6)], "document_id string, version int, ordinal int, heading_path array<string>, page int, content string")
    lib = lifecycle.park(lib, rows.select("document_id", "version", F.lit(5).alias("est_tokens")), now())
    drafts = contents.save_drafts(shelf.drafts, lib, rows)
    key = spark.createDataFrame([("d", 2)], "document_id string, version int")
    read = lambda **o: [(r.content, r.has_more) for r in contents.version_text(shelf.chunks, drafts, lib, key, **o).orderBy("ordinal").collect()]
    assert read(limit=2) == [("c0", True), ("c1", True)] and read(page=1) == [("c2", False), ("c3", False)] and read(after=4) == [("c5", False)]
    assert contents.version_text(shelf.chunks, drafts, lib, key.select("document_id", F.lit(None).cast("int").alias("version"))).count() == 0


def test_edges_are_curated_by_coordinate(spark):
    nodes = spark.createDataFrame([(1, "s", "José"), (2, "s", "Rex"), (3, "t", "José"), (4, "s", "rex ")], "id bigint, scope string, label string")
    edges = spark.createDataFrame([(10, "s", 1, 2, "OWNS", "proposed", ""), (11, "t", 3, 3, "OWNS", "proposed", "")], "id bigint, scope string, source_id bigint, target_id bigint, relation string, status string, audience string")
    changes = spark.createDataFrame([("s", "JOSE", "rex", "OWNS", "accepted"), ("s", "jose", "rex", "owns", "accepted"), ("t", "Ana", "Rex", "OWNS", "rejected")], "scope string, source string, target string, relation string, value string")
    new, found = graph.set_status(edges, nodes, changes)
    assert {(r.id, r.status) for r in new.collect()} == {(10, "accepted"), (11, "proposed")}
    assert {(r.source, r.relation, r.found) for r in found.collect()} == {("JOSE", "OWNS", True), ("jose", "owns", False), ("Ana", "OWNS", False)}
    audience = changes.withColumn("value", F.lit("identity:7"))
    assert {r.id for r in graph.set_audience(edges, nodes, audience)[0].where("audience = 'identity:7'").collect()} == {10}
    assert [(r.scope, r.reference, r.n_nodes) for r in graph.repeated_references(nodes).collect()] == [("s", "rex", 2)]
    written = spark.createDataFrame([("s", "José", "Lua", "SEES"), ("s", "lua", "Sol", "SEES"), ("t", "Lua", "Lua", "IS")], "scope string, source string, target string, relation string")
    placed, more = graph.create_missing(written, nodes, now())
    made = {(r.scope, r.label): r.id for r in more.where("id > 4").collect()}
    assert set(made) == {("s", "Lua"), ("s", "Sol"), ("t", "Lua")} or set(made) == {("s", "lua"), ("s", "Sol"), ("t", "Lua")}
    ids = {k[0] + k[1].lower(): v for k, v in made.items()}
    assert {(r.source_id, r.target_id) for r in placed.collect()} == {(1, ids["slua"]), (ids["slua"], ids["ssol"]), (ids["tlua"], ids["tlua"])}


def test_sessions_are_created_and_got(spark):
    u = "a1b2c3d4-0000-4000-8000-000000000001"
    stored = spark.createDataFrame([(u.upper(), "s", T, None, None)], "id string, scope string, started_at timestamp_ntz, ended_at timestamp_ntz, summary string")
    asked = spark.createDataFrame([("s", u), ("s", "x"), (" ", "y"), ("t", u.replace("-", ""))], "scope string, id string")
    got = sessions.create(stored, asked, now())
    assert {(r.scope, r.id, r.started_at == T) for r in got.collect()} == {("s", u, True), ("s", "x", False), ("t", u, False)}
    assert {r.scope for r in sessions.get(got, asked.where("scope = 's' AND id = 'x'").withColumn("scope", F.lit(None).cast("string"))).collect()} == {"s"}


def test_turns_of_one_session_in_any_notation(spark):
    u = "a1b2c3d4-0000-4000-8000-000000000001"
    rows = spark.createDataFrame([(1, "s", u, 0), (2, "s", u.upper(), 0), (3, "s", u.replace("-", ""), -1)], "id bigint, scope string, session_id string, turn_n int")
    assert [r.id for r in turns.save(None, rows)[1].collect()] == [2]
    assert {(r.id, r.turn_n, r.session_id) for r in turns.allocate(rows).collect()} == {(1, 0, u), (2, 0, u), (3, 1, u)}


def test_who_speaks_of_themselves(spark):
    df = spark.createDataFrame([("Meus dados",), ("What can I do",), ("iPhone II",), ("i am",), ("o eu lírico",), (None,), ("",)], "t string")
    assert [r.s for r in df.select(lexical.speaks_of_self(F.col("t")).alias("s")).collect()] == [True, True, False, True, True, False, False]


def test_nodes_are_embedded_anew(spark):
    nodes = spark.createDataFrame([(1, "abc", [0.0]), (2, None, [9.0])], "id bigint, label string, embedding array<float>")
    got = memories.reembed(nodes, lambda ts: [[float(len(t))] if t else [] for t in ts], text_col="label")
    assert {(r.id, r.embedding[0]) for r in got.collect()} == {(1, 3.0), (2, 9.0)}

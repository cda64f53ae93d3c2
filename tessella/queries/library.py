"""Queries over the life of document versions, publishing and the other operators that change state, each with its SQL.

Requests are made of the chunk table: every version of a document asks to be begun with its number as content, so that
the steps have rows to work on at every size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import buffer, chunking, contents, graph, ingest, lifecycle, memories, publishing, rerank, sessions, turns
from tessella.queries.knowledge import READER, VISIBLE
from tessella.queries.store import NOW, now, one_notation
from tessella.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = one_notation(sql)
        return f

    return add


# ---- versions

#: An owner for each document, and of its versions what asks to be begun.
ASKED = "(SELECT 'o' || substr(document_id, 1, 1) AS owner_key, document_id, 'c' || lpad(version::VARCHAR, 4, '0') AS sha256, coalesce(max(embed_model), 'none') AS embed_model, sum(octet_length(encode(coalesce(content, ''))))::BIGINT AS size_bytes, count(*) AS n FROM kb_chunks GROUP BY document_id, version)"
#: Begun versions: numbered per document by content.
BEGUN = f"(SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sha256, embed_model)::INT AS version FROM {ASKED})"


def _requests(spark, d):
    c = table(spark, d, "kb_chunks")
    rows = c.groupBy("document_id", F.col("version").alias("v")).agg(F.coalesce(F.max("embed_model"), F.lit("none")).alias("embed_model"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("size_bytes"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.concat(F.lit("o"), F.substring("document_id", 1, 1)).alias("owner_key"), "document_id", F.concat(F.lit("c"), F.lpad(F.col("v").cast("string"), 4, "0")).alias("sha256"), "embed_model", "size_bytes", "n")


def _begun(spark, d):
    return lifecycle.begin(lifecycle.Library.empty(spark), _requests(spark, d), now())


@query("versions_begun", f"SELECT document_id, version, owner_key, sha256, 'processing' AS state, size_bytes FROM {BEGUN}")
def _(spark, d):
    return _begun(spark, d).versions.select("document_id", "version", "owner_key", "sha256", "state", "size_bytes")


@query("versions_begun_again", f"SELECT document_id, max(version) AS versions, count(*) AS n FROM {BEGUN} GROUP BY 1")
def _(spark, d):
    again = lifecycle.begin(_begun(spark, d), _requests(spark, d), now())
    return again.versions.groupBy("document_id").agg(F.max("version").alias("versions"), F.count(F.lit(1)).alias("n"))


@query("versions_committed", f"SELECT document_id, version, CASE WHEN version = max(version) OVER (PARTITION BY document_id) THEN 'ready' ELSE 'superseded' END AS outcome FROM {BEGUN}")
def _(spark, d):
    lib = _begun(spark, d)
    return lifecycle.commit(lib, lib.versions.select("document_id", "version"), now())[1]


@query("versions_tombstoned", f"SELECT document_id, 'superseded' AS kind, string_agg(version::VARCHAR, ',' ORDER BY version) AS versions FROM (SELECT *, max(version) OVER (PARTITION BY document_id) AS top FROM {BEGUN}) WHERE version < top GROUP BY 1")
def _(spark, d):
    lib = _begun(spark, d)
    done = lifecycle.commit(lib, lib.versions.select("document_id", "version"), now())[0]
    return done.tombstones.select("document_id", "kind", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions"))


@query("versions_failed", f"SELECT document_id, version, CASE WHEN version % 2 = 1 THEN 'error' ELSE 'processing' END AS state, CASE WHEN version % 2 = 1 THEN 'no_text' END AS reason FROM {BEGUN}")
def _(spark, d):
    lib = _begun(spark, d)
    return lifecycle.fail(lib, lib.versions.where("version % 2 = 1").select("document_id", "version", F.lit("no_text").alias("reason")), now()).versions.select("document_id", "version", "state", "reason")


def _parked(spark, d):
    """Even versions wait, those of owners o0 to o7 until after NOW."""
    lib = _begun(spark, d)
    some = lib.versions.where("version % 2 = 0").select("document_id", "version", "owner_key", F.col("size_bytes").alias("est_tokens"))
    early = some.where("owner_key > 'o7'").drop("owner_key")
    lib = lifecycle.park(lib, early, now(), ttl_seconds=-60)
    return lifecycle.park(lib, some.where("owner_key <= 'o7'").drop("owner_key"), now())


@query("drafts_claimed", f"SELECT document_id, version, CASE WHEN version % 2 = 1 THEN 'missing' WHEN owner_key > 'o7' THEN 'expired' ELSE 'claimed' END AS outcome FROM {BEGUN}")
def _(spark, d):
    lib = _parked(spark, d)
    return lifecycle.claim(lib, lib.versions.select("document_id", "version"), now())[1]


@query("drafts_discarded", f"SELECT document_id, version, CASE WHEN version % 2 = 0 THEN 'discarded' ELSE 'not_a_draft' END AS outcome FROM {BEGUN}")
def _(spark, d):
    lib = _parked(spark, d)
    return lifecycle.discard(lib, lib.versions.select("document_id", "version"), now())[1]


@query("drafts_expired", f"SELECT document_id, version, CASE WHEN version % 2 = 1 THEN 'processing' WHEN owner_key > 'o7' THEN 'error' ELSE 'awaiting_confirmation' END AS state FROM {BEGUN}")
def _(spark, d):
    return lifecycle.expire(_parked(spark, d), now(), limit=None).versions.select("document_id", "version", "state")


@query("versions_interrupted", f"SELECT document_id, version, CASE WHEN version % 2 = 1 THEN 'error' ELSE 'awaiting_confirmation' END AS state FROM {BEGUN}")
def _(spark, d):
    return lifecycle.interrupt(_parked(spark, d), now() + F.expr("INTERVAL 1 HOUR"), limit=None).versions.select("document_id", "version", "state")


@query("library_listed", f"SELECT owner_key, document_id, NULL::INT AS active_version, max(version) AS latest_version, CASE WHEN max(version) % 2 = 0 THEN 'awaiting_confirmation' ELSE 'processing' END AS status FROM {BEGUN} GROUP BY 1, 2")
def _(spark, d):
    return lifecycle.listed(_parked(spark, d))


@query("library_subtree_purged", f"SELECT document_id, string_agg(version::VARCHAR, ',' ORDER BY version) AS versions, 'purged' AS kind FROM {BEGUN} WHERE owner_key = 'oa' GROUP BY 1")
def _(spark, d):
    gone = lifecycle.purge_subtree(_begun(spark, d), "oa", now())
    return lifecycle.tombstones(gone, "oa", 10_000).select("document_id", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions"), "kind")


@query("documents_deleted", f"SELECT document_id, count(*) AS n FROM {BEGUN} WHERE owner_key <> 'ob' GROUP BY 1")
def _(spark, d):
    lib = _begun(spark, d)
    return lifecycle.delete(lib, lib.versions.where("owner_key = 'ob'"), now()).versions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


# ---- what versions hold


def _shelf(spark, d):
    """Every begun version with the chunks of the table as its draft."""
    lib = _parked(spark, d)
    c = table(spark, d, "kb_chunks")
    known = lib.versions.select("document_id", "version", "sha256")
    rows = c.select("document_id", F.concat(F.lit("c"), F.lpad(F.col("version").cast("string"), 4, "0")).alias("sha256"), "ordinal", "heading_path", "page", "content", "embedding").join(known, ["document_id", "sha256"])
    return lib, rows


_DRAFTED = f"(SELECT b.document_id, b.version, b.owner_key, b.size_bytes, k.ordinal, k.page, k.content, k.embedding FROM {BEGUN} b JOIN kb_chunks k ON k.document_id = b.document_id AND 'c' || lpad(k.version::VARCHAR, 4, '0') = b.sha256)"


@query("drafts_pending", f"SELECT document_id, version, n_chunks, pages, est_tokens, row_number() OVER (ORDER BY document_id, version)::INT AS place FROM (SELECT document_id, version, count(*)::INT AS n_chunks, count(DISTINCT page)::INT AS pages, min(size_bytes) AS est_tokens FROM {_DRAFTED} WHERE version % 2 = 0 AND owner_key = 'o2' GROUP BY 1, 2)")
def _(spark, d):
    lib, rows = _shelf(spark, d)
    empty = ingest.Shelf.empty(spark)
    return contents.pending(contents.save_drafts(empty.drafts, lib, rows), lib, "o2").drop("expires_at")


@query("chunks_staged", f"SELECT document_id, version, CASE WHEN version % 2 = 0 THEN 'not_processing' WHEN bool_and(embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) THEN 'staged' ELSE 'bad_vector' END AS outcome FROM {_DRAFTED} GROUP BY 1, 2")
def _(spark, d):
    lib, rows = _shelf(spark, d)
    return contents.stage(ingest.Shelf.empty(spark).chunks, lib, rows.drop("sha256"), 64)[1]


@query("version_text", f"SELECT document_id, version, ordinal, content, total > 3 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY document_id, version ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY document_id, version) AS total FROM {_DRAFTED} WHERE version % 2 = 0 AND ordinal > 0) WHERE n <= 3")
def _(spark, d):
    lib, rows = _shelf(spark, d)
    empty = ingest.Shelf.empty(spark)
    drafts = contents.save_drafts(empty.drafts, lib, rows)
    return contents.version_text(empty.chunks, drafts, lib, lib.versions.select("document_id", "version"), after=0, limit=3).drop("heading_path", "page")


@query("originals_read", f"SELECT document_id, version, size_bytes FROM {BEGUN} QUALIFY version = max(version) OVER (PARTITION BY document_id)")
def _(spark, d):
    lib = _begun(spark, d)
    done = lifecycle.commit(lib, lib.versions.select("document_id", "version"), now())[0]
    held = lib.versions.select("document_id", "version", F.encode(F.repeat(F.lit("x"), F.col("size_bytes").cast("int")), "UTF-8").alias("data"))
    keys = lib.versions.select("document_id", F.lit(None).cast("int").alias("version"))
    return contents.original(held, done, keys).select("document_id", "version", F.octet_length("data").cast("bigint").alias("size_bytes"))


@query("texts_ingested", "SELECT doc_id::VARCHAR AS document_id, 1 AS version, 'ready' AS outcome FROM documents WHERE post_type = 'question' AND regexp_matches(text, '[a-zA-Z]{3}') AND octet_length(encode(text)) < 1000000")
def _(spark, d):
    docs = table(spark, d, "documents").where(r"post_type = 'question' AND text RLIKE '[a-zA-Z]{3}' AND octet_length(text) < 1000000")
    asked = docs.select(F.coalesce("source", F.lit("none")).alias("owner_key"), F.col("doc_id").cast("string").alias("document_id"), "title", F.encode("text", "UTF-8").alias("data"))
    return ingest.ingest(ingest.Shelf.empty(spark), asked, "hash-16", 16, ingest.hashing_embedder(16), now())[1]


@query("passages_joined", None)
def _(spark, d):
    c = table(spark, d, "kb_chunks")
    return chunking.join_passages(c).select("document_id", "version", "ordinal", "page", F.array_join("heading_path", "/").alias("heading_path"), "text")


# ---- publishing

_PUBLISHED = "(SELECT DISTINCT 'o' || substr(document_id, 1, 1) AS owner_key, document_id, CASE WHEN substr(document_id, 2, 1) = 'f' THEN 'text/plain' ELSE 'text/markdown' END AS media_type, CASE WHEN substr(document_id, 3, 1) IN ('a', 'b') THEN 'staff' ELSE 'all' END AS profile FROM kb_chunks)"


def _published(spark, d):
    c = table(spark, d, "kb_chunks").select("document_id").distinct()
    kind = F.when(F.substring("document_id", 2, 1) == "f", "text/plain").otherwise("text/markdown")
    profile = F.when(F.substring("document_id", 3, 1).isin("a", "b"), " staff ").otherwise("all")
    asked = c.select(F.concat(F.lit("o"), F.substring("document_id", 1, 1)).alias("owner_key"), "document_id", F.concat(F.lit(" Doc  "), F.substring("document_id", 1, 4)).alias("title"), F.array(profile, F.lit(""), profile).alias("profiles"), kind.alias("media_type"))
    return publishing.create(spark.createDataFrame([], publishing.DOCUMENT_SCHEMA), asked, now(), max_documents=30)


@query("documents_created", f"SELECT owner_key, document_id, CASE WHEN media_type = 'text/plain' THEN 'bad_media_type' WHEN sum((media_type <> 'text/plain')::INT) OVER (PARTITION BY owner_key ORDER BY document_id) > 30 THEN 'limit_reached' ELSE 'created' END AS outcome FROM {_PUBLISHED}")
def _(spark, d):
    return _published(spark, d)[1]


@query("documents_readable", f"SELECT p.document_id, max(b.version) AS version, 'Doc ' || substr(p.document_id, 1, 4) AS title FROM (SELECT *, sum((media_type <> 'text/plain')::INT) OVER (PARTITION BY owner_key ORDER BY document_id) AS n FROM {_PUBLISHED}) p JOIN {BEGUN} b ON b.document_id = p.document_id WHERE p.owner_key = 'o3' AND p.profile = 'all' AND p.media_type <> 'text/plain' AND p.n <= 30 GROUP BY p.document_id")
def _(spark, d):
    lib = _begun(spark, d)
    done = lifecycle.commit(lib, lib.versions.select("document_id", "version"), now())[0]
    return publishing.readable(_published(spark, d)[0], done, "o3", "all")


@query("profiles_set", f"SELECT document_id, CASE WHEN owner_key = 'o3' THEN 'new' ELSE profile END AS profiles FROM (SELECT *, sum((media_type <> 'text/plain')::INT) OVER (PARTITION BY owner_key ORDER BY document_id) AS n FROM {_PUBLISHED}) WHERE media_type <> 'text/plain' AND n <= 30")
def _(spark, d):
    docs = _published(spark, d)[0]
    changed = publishing.set_profiles(docs, docs.where("owner_key = 'o3'").select("owner_key", "document_id", F.array(F.lit(" new"), F.lit("new")).alias("profiles")))
    return changed.select("document_id", F.array_join("profiles", ",").alias("profiles"))


# ---- sessions, window, memories, graph


@query("sessions_created", f"SELECT scope, id, started_at FROM (SELECT scope, id, min(started_at) AS started_at FROM sessions GROUP BY 1, 2) UNION ALL SELECT DISTINCT t.scope, t.session_id, TIMESTAMP '{NOW}' FROM turns t ANTI JOIN (SELECT * FROM sessions) s ON s.scope = t.scope AND s.id = t.session_id WHERE regexp_matches(t.scope, '\\S') AND t.session_id IS NOT NULL")
def _(spark, d):
    asked = table(spark, d, "turns").select("scope", F.col("session_id").alias("id"))
    return sessions.create(table(spark, d, "sessions"), asked, now()).select("scope", "id", "started_at")


@query("sessions_got", "SELECT s.scope, s.id, min(s.started_at) AS started_at FROM (SELECT * FROM sessions) s SEMI JOIN (SELECT session_id, scope FROM turns WHERE scope = 't1') k ON k.session_id = s.id GROUP BY 1, 2")
def _(spark, d):
    keys = table(spark, d, "turns").where("scope = 't1'").select(F.upper("session_id").alias("id"), F.lit(None).cast("string").alias("scope"))
    return sessions.get(table(spark, d, "sessions"), keys).select("scope", "id", "started_at")


@query("traces_loaded", "SELECT scope, session_id, turn_n, min(id) AS id FROM turn_traces WHERE scope = 't1' AND session_id IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, d):
    t = table(spark, d, "turn_traces")
    keys = t.where("scope = 't1'").select("session_id", "scope")
    return turns.traces_of(t, keys).select("scope", "session_id", "turn_n", "id")


@query("buffer_cleared", "SELECT scope, session_id, count(*) AS n FROM turns t WHERE NOT coalesce(scope = 't1' AND session_id IS NOT NULL, false) GROUP BY 1, 2")
def _(spark, d):
    t = table(spark, d, "turns")
    return buffer.clear(t, t.where("scope = 't1' AND session_id IS NOT NULL")).groupBy("scope", "session_id").agg(F.count(F.lit(1)).alias("n"))


@query("buffer_trimmed", "SELECT scope, session_id, least(count(*), 3)::INT AS n FROM turns GROUP BY 1, 2")
def _(spark, d):
    return buffer.window(table(spark, d, "turns"), size=10, max_size=3).groupBy("scope", "session_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("memories_reranked_twice", "SELECT scope, id, final_place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC, place)::INT AS final_place FROM (SELECT *, coalesce(length(content), 0) % 7 AS s, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC NULLS LAST, id) AS place FROM memories) WHERE place <= 20) WHERE final_place <= 5")
def _(spark, d):
    m = table(spark, d, "memories")
    first = memories.recent(m, 50).join(m.select("id", "content"), "id").select("scope", "id", F.coalesce("content", F.lit("")).alias("content"), F.lit("q").alias("query_text"), F.col("place").alias("new_place"))
    # the scorer is injected: here the length of a text, modulo seven
    return rerank.second_pass(first, lambda q, c: [float(len(x) % 7) for x in c], 5, group=("scope",)).select("scope", "id", "final_place")


@query("memories_reembedded", "SELECT id, coalesce(length(content), 0) % 5 AS first FROM memories")
def _(spark, d):
    rows = memories.reembed(table(spark, d, "memories"), lambda texts: [[float(len(t) % 5)] * 64 for t in texts])
    return rows.select("id", F.get("embedding", F.lit(0)).cast("bigint").alias("first"))


@query("nodes_reembedded", "SELECT id, coalesce(length(label), 0) % 5 AS first FROM knowledge_nodes")
def _(spark, d):
    rows = memories.reembed(table(spark, d, "knowledge_nodes"), lambda texts: [[float(len(t) % 5)] * 64 for t in texts], text_col="label")
    return rows.select("id", F.get("embedding", F.lit(0)).cast("bigint").alias("first"))


@query("nodes_found", f"SELECT v.id FROM {VISIBLE} v SEMI JOIN (SELECT scope, min(lower(trim(label))) AS l FROM knowledge_nodes WHERE regexp_full_match(label, '[ -~]+') GROUP BY 1) w ON w.scope = v.scope AND w.l = lower(strip_accents(trim(v.label)))")
def _(spark, d):
    n, e = table(spark, d, "knowledge_nodes"), table(spark, d, "knowledge_edges")
    wanted = n.where("label RLIKE '^[ -~]+$'").groupBy("scope").agg(F.min(F.lower(F.trim("label"))).alias("l")).select("scope", F.concat(F.lit(" "), F.upper("l")).alias("wanted"))
    return graph.find(n, e, wanted, READER).select("id")


@query("edges_of_session_deleted", "SELECT id FROM knowledge_edges WHERE NOT coalesce(scope = 't1' AND source_session = (SELECT min(source_session) FROM knowledge_edges WHERE scope = 't1' AND trim(source_session) <> ''), false)")
def _(spark, d):
    e = table(spark, d, "knowledge_edges")
    s = e.where("scope = 't1' AND trim(source_session) <> ''").agg(F.min("source_session")).first()[0]
    return graph.delete_by_session(e, "t1", s or "none").select("id")


_PLACED = "(SELECT e.*, s.label AS source, t.label AS target FROM knowledge_edges e JOIN knowledge_nodes s ON s.scope = e.scope AND s.id = e.source_id JOIN knowledge_nodes t ON t.scope = e.scope AND t.id = e.target_id WHERE regexp_matches(s.label, '\\S') AND regexp_matches(t.label, '\\S'))"


def _placed(spark, d):
    n, e = table(spark, d, "knowledge_nodes"), table(spark, d, "knowledge_edges")
    for end in ("source", "target"):
        e = e.join(n.select("scope", F.col("id").alias(f"{end}_id"), F.col("label").alias(end)), ["scope", f"{end}_id"])
    return e.where("source RLIKE '\\\\S' AND target RLIKE '\\\\S'")


@query("edges_rejected_by_coordinate", f"SELECT count(*) AS n_found FROM (SELECT DISTINCT scope, source, target, relation FROM {_PLACED} WHERE scope <> 't1' UNION ALL SELECT 'x', 'nobody', 'nothing', 'R' WHERE false)")
def _(spark, d):
    changes = _placed(spark, d).where("scope <> 't1'").select("scope", "source", "target", "relation", F.lit("rejected").alias("value"))
    more = spark.createDataFrame([("x", "nobody", "nothing", "R", "rejected")], "scope string, source string, target string, relation string, value string")
    found = graph.set_status(table(spark, d, "knowledge_edges"), table(spark, d, "knowledge_nodes"), changes.unionByName(more))[1]
    return found.where("found").agg(F.count(F.lit(1)).alias("n_found"))


@query("concepts_created", f"SELECT DISTINCT scope, 'new ' || lower(source) AS label_key, 'CONCEPT' AS node_type FROM {_PLACED} WHERE regexp_full_match(source, '[a-zA-Z]+( [a-zA-Z]+)*')")
def _(spark, d):
    written = _placed(spark, d).where("source RLIKE '^[a-zA-Z]+( [a-zA-Z]+)*$'").select("scope", F.concat(F.lit("New "), "source").alias("source"), "target", "relation")
    nodes = table(spark, d, "knowledge_nodes")
    made = graph.create_missing(written, nodes, now())[1].where("label LIKE 'New %'").join(nodes.select("id"), "id", "left_anti")
    return made.select("scope", F.lower("label").alias("label_key"), "node_type")

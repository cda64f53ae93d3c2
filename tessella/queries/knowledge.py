"""Queries over the knowledge graph, documents, lexical relevance and maintenance, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.functions import scoring
from tessella.operators import chunking, documents, graph, lexical, maintenance
from tessella.queries.store import FOLD, NOW, TOKENS, now, terms_sql
from tessella.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
READER = "identity:39"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _ne(spark, d):
    return table(spark, d, "knowledge_nodes"), table(spark, d, "knowledge_edges")


_STATUS = "CASE WHEN status IS NULL OR trim(status) = '' THEN 'accepted' WHEN lower(trim(status)) IN ('accepted', 'proposed', 'rejected') THEN lower(trim(status)) ELSE 'proposed' END"
_AUD = "CASE WHEN trim(coalesce(audience, '')) = 'tenant' OR regexp_matches(trim(coalesce(audience, '')), '^identity:\\s*\\S') THEN trim(coalesce(audience, '')) ELSE '' END"
EDGES = f"(SELECT id, scope, source_id, target_id, relation, confidence, source_session, attributes, created_at, {_STATUS} AS status, {_AUD} AS audience FROM knowledge_edges)"
SEEN = f"(SELECT * FROM {EDGES} WHERE audience = 'tenant' OR audience = '{READER}')"
LIVE = f"(SELECT * FROM {SEEN} WHERE status = 'accepted')"
ENDS = "(SELECT scope, source_id AS node_id FROM {e} WHERE source_id IS NOT NULL UNION ALL SELECT scope, target_id FROM {e} WHERE target_id IS NOT NULL)"
VISIBLE = f"(SELECT n.* FROM knowledge_nodes n SEMI JOIN {ENDS.format(e=SEEN)} x ON x.scope = n.scope AND x.node_id = n.id)"
_TYPE = "CASE WHEN upper(trim(node_type)) IN ('PERSON', 'ANIMAL', 'PLACE', 'ORG', 'CONCEPT', 'OBJECT', 'EVENT') THEN upper(trim(node_type)) ELSE 'CONCEPT' END"
_KEY = FOLD.replace("replace(replace({c}, 'º', 'o'), 'ª', 'a')", "{c}")


@query("edges_visible", f"SELECT id, status, audience FROM {LIVE}")
def _(spark, d):
    return graph.visible_edges(_ne(spark, d)[1], READER).select("id", "status", "audience")


@query("nodes_visible", f"SELECT id, scope FROM {VISIBLE}")
def _(spark, d):
    return graph.visible_nodes(*_ne(spark, d), READER).select("id", "scope")


_LABEL = "regexp_replace(trim(regexp_replace(label, '\\s+', ' ', 'g')), '^ | $', '', 'g')"


@query("nodes_upserted", f"""WITH r AS (SELECT *, {_TYPE} AS nt, {_KEY.format(c="trim(regexp_replace(label, '[ \\t\\n\\r]+', ' ', 'g'))")} AS k, strip_accents(lower(label)) <> lower(label) AS acc FROM knowledge_nodes WHERE label IS NOT NULL AND trim(label) <> ''),
a AS (SELECT scope, nt, k, e.key AS ak, arg_max_null(e.value, id) AS av FROM (SELECT scope, nt, k, id, unnest(map_entries(attributes)) AS e FROM r) GROUP BY ALL),
b AS (SELECT scope, nt, k, string_agg(ak || '=' || coalesce(av, '~'), ';' ORDER BY ak) AS attributes FROM a GROUP BY ALL),
m AS (SELECT min(id) AS id, scope, nt, k, coalesce(arg_min(label, id) FILTER (WHERE acc), arg_min(label, id)) AS label, arg_max(embedding, id) FILTER (WHERE embedding IS NOT NULL) AS v, count(*) AS n_writes FROM r GROUP BY scope, nt, k)
SELECT m.id, m.scope, m.nt AS node_type, m.label, coalesce(b.attributes, '') AS attributes, coalesce(len(m.v), -1)::INT AS vector_size, round(coalesce(m.v[1]::DOUBLE, 0.0), 5) AS vector_first, m.n_writes FROM m LEFT JOIN b ON b.scope IS NOT DISTINCT FROM m.scope AND b.nt = m.nt AND b.k = m.k""")
def _(spark, d):
    rows = graph.upsert_nodes(_ne(spark, d)[0])
    entries = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~"))))
    first = F.round(F.coalesce(F.get("embedding", F.lit(0)).cast("double"), F.lit(0.0)), 5)
    return rows.select("id", "scope", "node_type", "label", F.array_join(entries, ";").alias("attributes"), F.coalesce(F.size("embedding"), F.lit(-1)).alias("vector_size"), first.alias("vector_first"), "n_writes")


@query("edges_upserted", f"""WITH w AS (SELECT * FROM {EDGES} WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
k AS (SELECT scope, source_id, target_id, relation, min(id) FILTER (WHERE status <> 'proposed') AS at, arg_min(status, id) FILTER (WHERE status <> 'proposed') AS st FROM w GROUP BY ALL),
a AS (SELECT w.*, coalesce(k.st, 'proposed') AS final FROM w JOIN k ON k.scope IS NOT DISTINCT FROM w.scope AND k.source_id = w.source_id AND k.target_id = w.target_id AND k.relation IS NOT DISTINCT FROM w.relation
 WHERE NOT (w.status = 'proposed' AND coalesce(k.st = 'accepted' AND w.id > k.at, false)))
SELECT min(id) AS id, scope, source_id, target_id, relation, min(final) AS status, coalesce(arg_min(audience, id) FILTER (WHERE audience <> ''), '') AS audience, round(max(confidence::DOUBLE), 6) AS confidence, count(*) AS n_applied FROM a GROUP BY scope, source_id, target_id, relation""")
def _(spark, d):
    return graph.upsert_edges(_ne(spark, d)[1])


@query("edges_missing_ends", f"SELECT DISTINCT scope, node_id FROM {ENDS.format(e='knowledge_edges')} e WHERE NOT EXISTS (SELECT 1 FROM knowledge_nodes n WHERE n.scope = e.scope AND n.id = e.node_id)")
def _(spark, d):
    n, e = _ne(spark, d)
    return graph.missing_endpoints(e, n)


@query("nodes_nearest", f"""WITH u AS (SELECT * FROM {VISIBLE} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT scope, arg_min(embedding, id) AS v FROM u GROUP BY 1)
SELECT scope, 'q' AS query_id, id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY similarity DESC, id) AS place FROM (SELECT u.scope, u.id, round(list_cosine_similarity(u.embedding::DOUBLE[], q.v::DOUBLE[]), 6) AS similarity FROM u JOIN q USING (scope))) WHERE place <= 5""")
def _(spark, d):
    n, e = _ne(spark, d)
    seed = graph.visible_nodes(n, e, READER).where(scoring.usable_vector(F.col("embedding"), 64)).groupBy("scope").agg(F.min_by("embedding", "id").alias("query_vector"))
    return graph.nearest(n, e, seed.withColumn("query_id", F.lit("q")), READER)


_STARTS = "(SELECT scope, min(id) AS start_id FROM knowledge_nodes GROUP BY 1 UNION SELECT scope, max(id) FROM knowledge_nodes GROUP BY 1)"


def _starts(spark, d):
    n = _ne(spark, d)[0]
    return n.groupBy("scope").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("scope", F.explode(F.array_distinct(F.array("a", "b"))).alias("start_id"))


def _walk_sql(depth: int) -> str:
    return f"""WITH RECURSIVE live AS MATERIALIZED (SELECT * FROM {LIVE} WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
two AS MATERIALIZED (SELECT scope, id, source_id AS a, target_id AS b FROM live UNION ALL SELECT scope, id, target_id, source_id FROM live),
r AS (SELECT scope, start_id, start_id AS node_id, 0 AS dist FROM {_STARTS} UNION SELECT r.scope, r.start_id, two.b, r.dist + 1 FROM r JOIN two ON two.scope = r.scope AND two.a = r.node_id WHERE r.dist + 1 < {depth})
SELECT r.scope, r.start_id, two.id AS edge_id, min(r.dist) + 1 AS depth FROM r JOIN two ON two.scope = r.scope AND two.a = r.node_id GROUP BY 1, 2, 3"""


for _depth in (1, 2, 3):
    query(f"walk_depth{_depth}", _walk_sql(_depth))(lambda spark, d, k=_depth: graph.walk(_ne(spark, d)[1], _starts(spark, d), READER, k))


@query("neighbours", f"SELECT DISTINCT * FROM (SELECT scope, source_id AS node_id, target_id AS other_id FROM {LIVE} UNION ALL SELECT scope, target_id, source_id FROM {LIVE}) WHERE node_id <> other_id")
def _(spark, d):
    return graph.neighbours(_ne(spark, d)[1], READER)


@query("graph_types", f"SELECT scope, {_TYPE} AS node_type, count(*) AS n_nodes FROM {VISIBLE} GROUP BY 1, 2")
def _(spark, d):
    return graph.type_histogram(*_ne(spark, d), READER)


@query("graph_degrees", f"""SELECT scope, id, degree, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY degree DESC, id) AS place FROM
(SELECT n.scope, n.id, count(x.node_id) AS degree FROM {VISIBLE} n LEFT JOIN {ENDS.format(e=LIVE)} x ON x.scope = n.scope AND x.node_id = n.id GROUP BY 1, 2)) WHERE place <= 5""")
def _(spark, d):
    return graph.top_degrees(*_ne(spark, d), READER)


@query("nodes_listed", f"SELECT scope, id, place FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY id) AS place FROM {VISIBLE} WHERE {_TYPE} = 'PERSON') WHERE place <= 100")
def _(spark, d):
    return graph.listed(*_ne(spark, d), READER, "PERSON")


@query("nodes_counted", f"SELECT scope, count(*) AS n_nodes FROM {VISIBLE} WHERE {_TYPE} = 'ORG' GROUP BY 1")
def _(spark, d):
    return graph.counted(*_ne(spark, d), READER, kind="ORG")


@query("nodes_scanned", f"SELECT id, scope FROM {VISIBLE} WHERE id > 100 ORDER BY id LIMIT 1000")
def _(spark, d):
    return graph.scanned(*_ne(spark, d), READER, 100)


@query("nodes_with_edges", f"SELECT n.id FROM knowledge_nodes n SEMI JOIN {ENDS.format(e='knowledge_edges')} x ON x.scope = n.scope AND x.node_id = n.id")
def _(spark, d):
    return graph.with_edges(*_ne(spark, d)).select("id")


@query("edges_pending", f"""SELECT scope, id, source_label, relation, target_label, place FROM (SELECT e.scope, e.id, s.label AS source_label, e.relation, t.label AS target_label, row_number() OVER (PARTITION BY e.scope ORDER BY e.created_at NULLS FIRST, e.id) AS place
FROM {SEEN} e JOIN knowledge_nodes s ON s.scope = e.scope AND s.id = e.source_id JOIN knowledge_nodes t ON t.scope = e.scope AND t.id = e.target_id WHERE e.status = 'proposed') WHERE place <= 100""")
def _(spark, d):
    n, e = _ne(spark, d)
    return graph.pending(e, n, READER)


_DETAIL = "array_to_string(list_transform(list_filter(list_transform(list_sort(map_entries(e.attributes)), lambda x: {'k': x.key, 'v': trim(regexp_replace(x.value, '\\s+', ' ', 'g'))}), lambda x: x.v <> ''), lambda x: x.k || ': ' || x.v), '; ')"


@query("graph_context", f"""WITH w AS ({_walk_sql(2)}),
l AS (SELECT w.scope, w.start_id, w.depth, w.edge_id, s.label AS a, e.relation AS r, t.label AS b, coalesce({_DETAIL}, '') AS dt FROM w JOIN knowledge_edges e ON e.scope = w.scope AND e.id = w.edge_id JOIN knowledge_nodes s ON s.scope = e.scope AND s.id = e.source_id JOIN knowledge_nodes t ON t.scope = e.scope AND t.id = e.target_id),
n AS (SELECT *, '- ' || a || ' --[' || r || ']--> ' || b || CASE WHEN dt = '' THEN '' WHEN length(dt) > 120 THEN ' (' || rtrim(dt[1:119]) || '…)' ELSE ' (' || dt || ')' END AS line FROM l),
u AS (SELECT *, 17 + sum(length(line) + 1) OVER (PARTITION BY scope, start_id ORDER BY depth, edge_id) AS used FROM n WHERE line IS NOT NULL)
SELECT scope, start_id, '[Knowledge Graph]' || chr(10) || string_agg(line, chr(10) ORDER BY depth, edge_id) AS context FROM u WHERE used <= 2000 GROUP BY 1, 2""")
def _(spark, d):
    n, e = _ne(spark, d)
    return graph.context(graph.context_lines(graph.walk(e, _starts(spark, d), READER, 2), e, n))


@query("node_deleted", f"WITH gone AS (SELECT scope, min(id) AS id FROM knowledge_nodes GROUP BY 1) SELECT e.id FROM knowledge_edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.scope = e.scope AND g.id = e.source_id) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.scope = e.scope AND g.id = e.target_id)")
def _(spark, d):
    n, e = _ne(spark, d)
    return graph.delete_node(n, e, n.groupBy("scope").agg(F.min("id").alias("id")))[1].select("id")


# ---- maintenance


@query("orphan_nodes", f"SELECT n.scope, n.id FROM knowledge_nodes n ANTI JOIN {ENDS.format(e='knowledge_edges')} x ON x.scope = n.scope AND x.node_id = n.id")
def _(spark, d):
    return maintenance.orphan_nodes(*_ne(spark, d))


_VOICES = "(SELECT session_id AS source_session, min(voiced_by) AS identity FROM turns WHERE voiced_by <> '' AND session_id IS NOT NULL GROUP BY 1)"


@query("audience_classified", f"""SELECT e.id, CASE WHEN trim(coalesce(e.source_session, '')) = '' THEN 'tenant' WHEN v.identity IS NOT NULL THEN 'identity:' || v.identity ELSE '' END AS new_audience,
CASE WHEN trim(coalesce(e.source_session, '')) = '' THEN 'tenant' WHEN v.identity IS NOT NULL THEN 'identity' ELSE 'unresolved' END AS outcome
FROM {EDGES} e LEFT JOIN {_VOICES} v ON v.source_session = e.source_session WHERE e.audience = '' AND e.status <> 'rejected'""")
def _(spark, d):
    voices = table(spark, d, "turns").where("voiced_by <> '' AND session_id IS NOT NULL").groupBy(F.col("session_id").alias("source_session")).agg(F.min("voiced_by").alias("identity"))
    return maintenance.classify_audience(_ne(spark, d)[1], voices)


@query("edges_demoted", f"SELECT id FROM {EDGES} WHERE status = 'accepted' AND relation IN ('FRIEND_OF', 'RELATED_TO') AND trim(coalesce(source_session, '')) <> ''")
def _(spark, d):
    return maintenance.demote(_ne(spark, d)[1], ("FRIEND_OF", "RELATED_TO"))


COLLIDE = f"""(WITH r AS (SELECT n.scope, n.id, {_TYPE} AS node_type, {_KEY.format(c='trim(label)')} AS k, (SELECT count(*) FROM knowledge_edges e WHERE e.scope = n.scope AND e.source_id = n.id) + (SELECT count(*) FROM knowledge_edges e WHERE e.scope = n.scope AND e.target_id = n.id) AS degree FROM knowledge_nodes n WHERE label IS NOT NULL)
SELECT scope, node_type, id, degree, first_value(id) OVER (PARTITION BY scope, node_type, k ORDER BY degree DESC, id) AS survivor_id, count(*) OVER (PARTITION BY scope, node_type, k) AS n FROM r)"""


@query("fold_collisions", f"SELECT scope, node_type, id, degree, survivor_id FROM {COLLIDE} WHERE n > 1")
def _(spark, d):
    return maintenance.fold_collisions(*_ne(spark, d)).drop("label_key")


@query("fold_merged", f"""WITH l AS (SELECT scope, id, survivor_id FROM {COLLIDE} WHERE n > 1 AND id <> survivor_id),
m AS (SELECT e.id, e.scope, coalesce(a.survivor_id, e.source_id) AS source_id, coalesce(b.survivor_id, e.target_id) AS target_id, e.relation, a.id IS NOT NULL OR b.id IS NOT NULL AS moved FROM knowledge_edges e LEFT JOIN l a ON a.scope = e.scope AND a.id = e.source_id LEFT JOIN l b ON b.scope = e.scope AND b.id = e.target_id),
k AS (SELECT *, bool_or(moved) OVER w AS t, row_number() OVER (w ORDER BY id) AS n FROM m WHERE NOT (moved AND coalesce(source_id = target_id, false)) WINDOW w AS (PARTITION BY scope, source_id, target_id, relation))
SELECT id, scope, source_id, target_id, relation FROM k WHERE NOT t OR n = 1""")
def _(spark, d):
    return maintenance.merge_collisions(*_ne(spark, d))[0]


# ---- documents

SERVED = "(SELECT c.* FROM kb_chunks c JOIN (SELECT document_id, max(version) AS version FROM kb_chunks GROUP BY 1) v USING (document_id, version))"


@query("doc_versions", "SELECT document_id, version, max(embed_model) AS embed_model, count(*) AS n_chunks, sum(ceil(length(content) / 4.0))::BIGINT AS est_tokens FROM kb_chunks GROUP BY 1, 2")
def _(spark, d):
    return documents.versions(table(spark, d, "kb_chunks"))


@query("doc_served", f"SELECT document_id, version, ordinal FROM {SERVED}")
def _(spark, d):
    return documents.swap(table(spark, d, "kb_chunks"), now())[0].select("document_id", "version", "ordinal")


@query("doc_tombstones", f"SELECT document_id, 'superseded' AS kind, string_agg(version::VARCHAR, ',' ORDER BY version) AS versions, TIMESTAMP '{NOW}' AS removed_at FROM (SELECT DISTINCT document_id, version, max(version) OVER (PARTITION BY document_id) AS top FROM kb_chunks) WHERE version < top GROUP BY 1")
def _(spark, d):
    return documents.swap(table(spark, d, "kb_chunks"), now())[1]


@query("doc_sections", f"""WITH h AS (SELECT document_id, ordinal, i - 1 AS depth, trim(regexp_replace(heading_path[i], '\\s+', ' ', 'g')) AS heading FROM {SERVED} c, unnest(range(1, len(heading_path) + 1)) u(i)),
f AS (SELECT document_id, depth, heading, min(ordinal) AS first FROM h WHERE heading <> '' GROUP BY 1, 2, 3),
dp AS (SELECT document_id, min(depth) AS depth FROM (SELECT document_id, depth FROM f GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
SELECT document_id, place, heading FROM (SELECT f.document_id, f.heading, row_number() OVER (PARTITION BY f.document_id ORDER BY first, heading) AS place FROM f JOIN dp USING (document_id, depth)) WHERE place <= 50""")
def _(spark, d):
    return documents.sections(table(spark, d, "kb_chunks"))


@query("doc_models_unavailable", f"SELECT DISTINCT embed_model FROM {SERVED} WHERE embed_model <> 'em-small-64'")
def _(spark, d):
    return documents.unavailable_models(table(spark, d, "kb_chunks"), "em-small-64")


ASK = "night market and the choir rehearsal"


def _doc_queries(spark, d, vector: bool):
    c = table(spark, d, "kb_chunks").where(scoring.usable_vector(F.col("embedding"), 64))
    v = c.agg(F.min_by("embedding", F.struct("document_id", "version", "ordinal")).alias("query_vector"))
    one = v if vector else spark.range(1).select(F.lit(None).cast("array<float>").alias("query_vector"))
    return one.select(F.lit("q").alias("query_id"), F.lit(ASK).alias("query_text"), "query_vector")


_WORDS = "list_distinct(regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}_]+'))"


#: The chunks of a library with one embedding model.
ONE_MODEL = "(SELECT * FROM kb_chunks WHERE embed_model = 'em-small-64')"


def _search_sql(vector: bool) -> str:
    lex = "len(list_intersect(q.w, c.w)) / len(q.w)::DOUBLE"
    cos = "CASE WHEN c.embedding IS NOT NULL AND len(c.embedding) = 64 AND list_sum(list_transform(c.embedding, lambda x: x::DOUBLE * x)) > 0 THEN list_cosine_similarity(c.embedding::DOUBLE[], q.v::DOUBLE[]) ELSE 0.0 END"
    score = f"(greatest(0.0, least(1.0, CASE WHEN isnan({cos}) THEN 0.0 ELSE {cos} END)) * 0.60 + {lex} * 0.40) / 1.0" if vector else lex
    v = "(SELECT arg_min(embedding, (document_id, version, ordinal)) FROM kb_chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
    return f"""WITH q AS (SELECT {_WORDS.format(c=chr(39) + ASK + chr(39))} AS w, {v} AS v), c AS (SELECT document_id, version, ordinal, embedding, coalesce({_WORDS.format(c='content')}, []) AS w FROM {SERVED})
SELECT 'q' AS query_id, document_id, version, ordinal, score, place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, document_id, version, ordinal) AS place FROM (SELECT document_id, version, ordinal, round({score}, 6) AS score, {lex} AS l FROM c, q) WHERE {'true' if vector else 'l > 0'}) WHERE place <= 5"""


@query("doc_search_lexical", _search_sql(False))
def _(spark, d):
    # without a vector of the query only words count
    return documents.search(table(spark, d, "kb_chunks"), _doc_queries(spark, d, False))


@query("doc_search_hybrid", re.sub(r"FROM kb_chunks\b(?! WHERE embed_model)", "FROM " + ONE_MODEL, _search_sql(True)))
def _(spark, d):
    # where every model is the query's, vectors count
    return documents.search(table(spark, d, "kb_chunks").where("embed_model = 'em-small-64'"), _doc_queries(spark, d, True), "em-small-64")


@query("doc_search_models_differ", _search_sql(False))
def _(spark, d):
    # where one is not, they do not
    return documents.search(table(spark, d, "kb_chunks").where("document_id IS NOT NULL"), _doc_queries(spark, d, True), "no-such-model")


@query("doc_read", f"SELECT document_id, ordinal, content, total > 5 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY document_id) AS total FROM {SERVED} WHERE ordinal > 1) WHERE n <= 5")
def _(spark, d):
    return documents.read(table(spark, d, "kb_chunks"), after=1, limit=5)


@query("doc_stale", f"SELECT document_id, version, max(embed_model) AS embed_model FROM {SERVED} GROUP BY 1, 2 HAVING max(embed_model) IS DISTINCT FROM 'em-small-64'")
def _(spark, d):
    return documents.stale(table(spark, d, "kb_chunks"), "em-small-64")


@query("documents_chunked")
def _(spark, d):
    rows = chunking.chunk_documents(table(spark, d, "documents"))
    return rows.withColumn("heading_path", F.array_join("heading_path", chunking.ChunkConfig().separator))


# ---- lexical relevance

QUESTION = "quando é a aula de cerâmica da lista de espera"
CANDS = f"""(WITH g AS (SELECT e.scope, 'edge:' || e.id AS id, 'graph' AS source, s.label || ' ' || replace(e.relation, '_', ' ') || ' ' || t.label AS body, e.id AS prior, array_to_string({TOKENS.format(c='s.label')}, ' ') AS head, array_to_string({TOKENS.format(c='t.label')}, ' ') AS tail,
 row_number() OVER (PARTITION BY e.scope, lower(s.label), e.relation, lower(t.label) ORDER BY e.id) AS n FROM {LIVE} e JOIN knowledge_nodes s ON s.scope = e.scope AND s.id = e.source_id JOIN knowledge_nodes t ON t.scope = e.scope AND t.id = e.target_id)
SELECT scope, id, source, body, prior, head, tail FROM g WHERE n = 1 UNION ALL SELECT scope, 'memory:' || id, 'memory', content, row_number() OVER (PARTITION BY scope ORDER BY created_at NULLS FIRST, id), '', '' FROM memories WHERE regexp_matches(content, '\\S'))"""
RANKED = f"""(WITH o AS (SELECT *, coalesce(len(list_intersect({terms_sql(chr(39) + QUESTION + chr(39))}, {terms_sql('body')})) / len({terms_sql(chr(39) + QUESTION + chr(39))})::DOUBLE, 0.0) AS own FROM {CANDS}),
b AS (SELECT scope, tail AS head, max(own) AS best FROM o WHERE source = 'graph' AND own > 0 AND tail <> '' GROUP BY 1, 2),
s AS (SELECT o.scope, o.id, o.source, o.prior, o.head, o.tail, round(greatest(own, CASE WHEN o.source = 'graph' AND o.head <> '' THEN coalesce(b.best, 0) * 0.5 ELSE 0 END), 6) AS score FROM o LEFT JOIN b ON b.scope = o.scope AND b.head = o.head)
SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, CASE source WHEN 'graph' THEN 0 ELSE 1 END, prior, id) AS place FROM s)"""


#: Of each scope as many as are ranked at most.
RANKED = f"(SELECT * FROM {RANKED} WHERE place <= 2000)"


def _ranked(spark, d):
    n, e = _ne(spark, d)
    c = lexical.graph_candidates(graph.visible_edges(e, READER), n).unionByName(lexical.memory_candidates(table(spark, d, "memories")))
    return lexical.rank(c, [QUESTION])


@query("lexical_ranked", f"SELECT scope, id, source, score, place FROM {RANKED}")
def _(spark, d):
    return _ranked(spark, d).select("scope", "id", "source", "score", "place")


@query("lexical_chosen", f"SELECT scope, id, score, place FROM {RANKED} WHERE score >= 0.3 AND place <= 5")
def _(spark, d):
    return lexical.chosen(_ranked(spark, d)).select("scope", "id", "score", "place")


@query("lexical_decided", f"""SELECT scope, CASE WHEN h > 0 THEN 'relevant' WHEN p > 0 THEN 'partial' ELSE 'nothing_relevant' END AS decision, least(CASE WHEN h > 0 THEN h ELSE p END, 5) AS n_picked FROM
(SELECT scope, count(*) FILTER (WHERE score >= 0.3 AND score > 0) AS h, count(*) FILTER (WHERE contains(' ' || head || ' ', ' maria ') OR contains(' ' || tail || ' ', ' maria ') OR contains(' ' || head || ' ', ' roberto ') OR contains(' ' || tail || ' ', ' roberto ')) AS p FROM {RANKED} GROUP BY 1)""")
def _(spark, d):
    return lexical.decide(_ranked(spark, d), ["Maria", "Roberto"])


@query("tokens_counted", f"SELECT scope, t AS token, count(*) AS n FROM (SELECT scope, unnest({TOKENS.format(c='content')}) AS t FROM memories) GROUP BY 1, 2")
def _(spark, d):
    from tessella.functions import text

    return table(spark, d, "memories").select("scope", F.explode(text.tokens(F.col("content"))).alias("token")).groupBy("scope", "token").agg(F.count(F.lit(1)).alias("n"))

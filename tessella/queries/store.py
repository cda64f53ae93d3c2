"""Queries over sessions, turns, traces, the short-term window and memories, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.functions.text import MASKS, STOPWORDS
from tessella.operators import buffer, consolidation, memories, rerank, sessions, turns
from tessella.sources.tables import table

NOW = "2026-06-08 12:00:00"
QUERIES: dict = {}
SQL: dict = {}


_H = "lower(replace({c}, '-', ''))"
#: An id with equal UUIDs in one notation.
SID = "CASE WHEN regexp_full_match(" + _H + ", '[0-9a-f]{{32}}') THEN concat_ws('-', " + ", ".join(f"{_H}[{a}:{b}]" for a, b in ((1, 8), (9, 12), (13, 16), (17, 20), (21, 32))) + ") ELSE {c} END"


def one_notation(sql: str) -> str:
    """The SQL over turns, traces and sessions whose ids are in one notation."""
    for name, column in (("turns", "session_id"), ("turn_traces", "session_id"), ("sessions", "id")):
        sql = re.sub(rf"\bFROM {name}\b", f'FROM (SELECT * REPLACE ({SID.format(c=column)} AS {column}) FROM "{name}")', sql)
    return sql


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = one_notation(sql)
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


FOLD = "strip_accents(lower(replace(replace({c}, 'º', 'o'), 'ª', 'a')))"
TOKENS = "list_transform(regexp_extract_all(" + FOLD + ", '[a-z0-9]{{2,}}'), lambda t: CASE WHEN len(t) >= 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END)"
STORED = "(SELECT scope, id, min(started_at) AS started_at, max(ended_at) AS ended_at, max(summary) AS summary FROM sessions GROUP BY 1, 2)"
IDLE = f"""(SELECT t.scope, t.session_id, min(t.created_at) AS started_at, max(t.created_at) AS last_at, count(*) AS n_turns
FROM turns t LEFT JOIN {STORED} s ON s.scope = t.scope AND s.id = t.session_id
WHERE t.consolidated_at IS NULL AND (s.id IS NULL OR s.ended_at IS NULL OR t.created_at > s.ended_at)
GROUP BY 1, 2 HAVING max(t.created_at) < TIMESTAMP '{NOW}' - INTERVAL 1800 SECOND)"""


@query("sessions_recent", f"SELECT scope, id, started_at, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY started_at DESC NULLS LAST, id) AS place FROM {STORED}) WHERE place <= 5")
def _(spark, d):
    return sessions.recent(table(spark, d, "sessions"))


@query("sessions_active", f"SELECT scope, id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY started_at DESC, id DESC) AS n FROM {STORED} WHERE ended_at IS NULL AND started_at > TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND started_at <= TIMESTAMP '{NOW}') WHERE n = 1")
def _(spark, d):
    return sessions.active(table(spark, d, "sessions"), now(), within_seconds=90 * 86_400)


@query("sessions_idle", f"SELECT * FROM {IDLE}")
def _(spark, d):
    return sessions.idle(table(spark, d, "turns"), table(spark, d, "sessions"), now())


def _closing(spark, d):
    return sessions.idle(table(spark, d, "turns"), table(spark, d, "sessions"), now()).select("scope", "session_id", now().alias("ended_at"), F.lit("closed idle").alias("summary"))


@query("sessions_closed", f"SELECT coalesce(s.scope, i.scope) AS scope, coalesce(s.id, i.session_id) AS id, coalesce(s.started_at, TIMESTAMP '{NOW}') AS started_at, CASE WHEN i.scope IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE s.ended_at END AS ended_at, CASE WHEN i.scope IS NOT NULL THEN 'closed idle' ELSE s.summary END AS summary FROM {STORED} s FULL JOIN {IDLE} i ON i.scope = s.scope AND i.session_id = s.id")
def _(spark, d):
    return sessions.close(table(spark, d, "sessions"), _closing(spark, d))


@query("turns_stamped", f"SELECT t.id, CASE WHEN t.consolidated_at IS NULL AND i.scope IS NOT NULL AND t.created_at <= TIMESTAMP '{NOW}' THEN TIMESTAMP '{NOW}' ELSE t.consolidated_at END AS consolidated_at FROM turns t LEFT JOIN {IDLE} i ON i.scope = t.scope AND i.session_id = t.session_id")
def _(spark, d):
    return sessions.stamp(table(spark, d, "turns"), _closing(spark, d)).select("id", "consolidated_at")


def _numbered(spark, d):
    return table(spark, d, "turns").where("session_id IS NOT NULL AND turn_n >= 0")


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY scope, session_id, turn_n ORDER BY id) AS n FROM turns WHERE session_id IS NOT NULL AND turn_n >= 0)"


@query("turns_saved", f"SELECT id, scope, session_id, turn_n FROM {_RANKED} WHERE n = 1")
def _(spark, d):
    return turns.save(None, _numbered(spark, d))[0].select("id", "scope", "session_id", "turn_n")


@query("turns_lost", f"SELECT id, substr(sha256(scope), 1, 12) AS scope_digest FROM {_RANKED} WHERE n > 1")
def _(spark, d):
    return turns.save(None, _numbered(spark, d))[1].select("id", turns.scope_digest(F.col("scope")).alias("scope_digest"))


_ANCHOR = "(SELECT *, first_value(created_at) OVER w AS at0, first_value(id) OVER w AS id0 FROM turn_traces WINDOW w AS (PARTITION BY scope, session_id, turn_n ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_FITS = "(id = id0 OR coalesce(created_at <= at0 + INTERVAL 3600 SECOND, false))"


@query("write_loss_counts", f"SELECT 'turn_conflict' AS loss_event, count(*) AS n FROM {_RANKED} WHERE n > 1 UNION ALL SELECT 'turn_allocation_exhausted', 0 UNION ALL SELECT 'trace_refused', count(*) FROM {_ANCHOR} WHERE NOT {_FITS}")
def _(spark, d):
    lost = turns.save(None, _numbered(spark, d))[1].select(F.lit("turn_conflict").alias("loss_event"))
    refused = turns.revise_traces(table(spark, d, "turn_traces"))[1].select(F.lit("trace_refused").alias("loss_event"))
    return turns.loss_counts(lost.unionByName(refused))


@query("turns_allocated", "SELECT id, CASE WHEN turn_n < 0 THEN coalesce(max(CASE WHEN turn_n >= 0 THEN turn_n END) OVER (PARTITION BY scope, session_id), 0) + sum((turn_n < 0)::INT) OVER (PARTITION BY scope, session_id ORDER BY id) ELSE turn_n END AS turn_n FROM turns")
def _(spark, d):
    return turns.allocate(table(spark, d, "turns")).select("id", "turn_n")


def _masks(c: str) -> str:
    out = c
    for p, to in MASKS:
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return out


@query("turns_masked", f"SELECT id, CASE WHEN len(pii_types) > 0 THEN {_masks('user_input')} ELSE user_input END AS user_input, CASE WHEN len(pii_types) > 0 THEN {_masks('response')} ELSE response END AS response FROM turns")
def _(spark, d):
    return turns.masked(table(spark, d, "turns")).select("id", "user_input", "response")


@query("turns_responses_updated", "SELECT t.id, coalesce(u.v, t.response) AS response FROM turns t LEFT JOIN (SELECT scope, session_id, turn_n, arg_max(response, id) AS v FROM turns WHERE response IS NOT NULL GROUP BY 1, 2, 3) u ON u.scope = t.scope AND u.session_id = t.session_id AND u.turn_n = t.turn_n")
def _(spark, d):
    t = table(spark, d, "turns")
    changes = t.where("response IS NOT NULL").select("scope", "session_id", "turn_n", F.col("id").alias("seq"), F.col("response").alias("value"))
    return turns.update(t, changes, "response").select("id", "response")


@query("turns_feedback_set", "SELECT t.id, coalesce(u.v, t.feedback) AS feedback FROM turns t LEFT JOIN (SELECT scope, session_id, turn_n, arg_max(feedback, id) AS v FROM turns WHERE feedback <> 0 GROUP BY 1, 2, 3) u ON u.scope = t.scope AND u.session_id = t.session_id AND u.turn_n = t.turn_n")
def _(spark, d):
    t = table(spark, d, "turns")
    changes = t.where("feedback <> 0").select("scope", "session_id", "turn_n", F.col("id").alias("seq"), F.col("feedback").alias("value"))
    return turns.update(t, changes, "feedback").select("id", "feedback")


@query("turns_loaded", "SELECT scope, session_id, turn_n, id, row_number() OVER (PARTITION BY scope, session_id ORDER BY turn_n NULLS FIRST, id) AS place FROM turns")
def _(spark, d):
    return turns.load(table(spark, d, "turns"))


@query("turn_counts", "SELECT scope, session_id, count(*) AS n_turns FROM turns GROUP BY 1, 2")
def _(spark, d):
    return turns.counts(table(spark, d, "turns"))


@query("turns_recent", "SELECT scope, id, session_id, turn_n, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC NULLS LAST, id DESC) AS place FROM turns) WHERE place <= 5")
def _(spark, d):
    return turns.recent(table(spark, d, "turns"))


_T1 = "(scope = 't1' OR starts_with(scope, 't1/'))"


@query("admin_turns_page", f"SELECT id, scope FROM turns WHERE {_T1} ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 30 OFFSET 30")
def _(spark, d):
    return turns.page(table(spark, d, "turns"), "t1", offset=30)[0].select("id", "scope")


@query("admin_turns_total", f"SELECT count(*) AS total FROM turns WHERE {_T1}")
def _(spark, d):
    return turns.page(table(spark, d, "turns"), "t1")[1]


@query("admin_scopes", "SELECT DISTINCT scope FROM turns WHERE scope = 't10' OR starts_with(scope, 't10/')")
def _(spark, d):
    return turns.scopes(table(spark, d, "turns"), "t10")


@query("traces_revised", f"SELECT scope, session_id, turn_n, min(id0) AS id, max(id) AS content_id, arg_max(trace, id) AS trace, min(at0) AS created_at FROM (SELECT id, scope, session_id, turn_n, id0, at0, created_at, coalesce(trace, '~null') AS trace FROM {_ANCHOR}) WHERE {_FITS} GROUP BY 1, 2, 3")
def _(spark, d):
    return turns.revise_traces(table(spark, d, "turn_traces"))[0].withColumn("trace", F.coalesce("trace", F.lit("~null")))


@query("admin_traces_page", f"SELECT id FROM turn_traces WHERE {_T1} AND created_at >= TIMESTAMP '2025-06-01' ORDER BY created_at DESC NULLS LAST, session_id DESC NULLS LAST, turn_n DESC NULLS LAST, id DESC NULLS LAST LIMIT 1000")
def _(spark, d):
    return turns.trace_page(table(spark, d, "turn_traces"), "t1", F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).select("id")


# ---- short-term window


@query("buffer_window", "SELECT scope, session_id, id, row_number() OVER (PARTITION BY scope, session_id ORDER BY id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY scope, session_id ORDER BY id DESC) AS n FROM turns) WHERE n <= 10")
def _(spark, d):
    return buffer.window(table(spark, d, "turns"))


@query("buffer_live", f"SELECT scope, session_id, max(created_at) AS last_at, count(*) AS n_pushed, least(count(*), 50) AS n_held FROM turns GROUP BY 1, 2 HAVING max(created_at) >= TIMESTAMP '{NOW}' - INTERVAL 86400 SECOND")
def _(spark, d):
    return buffer.live(table(spark, d, "turns"), now())


# ---- memories


@query("memories_saved", "SELECT arg_min(id, (created_at, id)) AS id, scope, category, content, round(arg_max_null(confidence, (created_at, id)), 4) AS confidence, arg_min(coalesce(feedback_score, -99), (created_at, id)) AS feedback_score, min(created_at) AS created_at, count(embedding) > 0 AS has_vector, count(*) AS n_writes FROM memories GROUP BY scope, category, content")
def _(spark, d):
    rows = memories.save(table(spark, d, "memories"))
    return rows.select("id", "scope", "category", "content", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), F.coalesce(F.col("feedback_score").cast("double"), F.lit(-99.0)).alias("feedback_score"), "created_at", F.col("embedding").isNotNull().alias("has_vector"), "n_writes")


@query("memories_recent", "SELECT scope, id, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC NULLS LAST, id) AS place FROM memories WHERE category IN ('fact', 'preference')) WHERE place <= 50")
def _(spark, d):
    return memories.recent(table(spark, d, "memories"), categories=["fact", "preference"])


TEXT = "tem vaga na aula de cerâmica da lista de espera?"
TWO_WORDS = "a aula de cerâmica"
USABLE = "(embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
COS = "list_cosine_similarity(m.embedding::DOUBLE[], q.v::DOUBLE[])"


def stop_list() -> str:
    return "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def terms_sql(c: str) -> str:
    return f"list_distinct(list_filter({TOKENS.format(c=c)}, lambda t: NOT list_contains({stop_list()}, t)))"


def _queries(spark, d, with_text: bool, with_vector: bool, text: str = TEXT):
    m = table(spark, d, "memories")
    from tessella.functions import scoring

    seed = m.where(scoring.usable_vector(F.col("embedding"), 64)).groupBy("scope").agg(F.min_by("embedding", "id").alias("v"))
    base = seed if with_vector else m.select("scope").distinct()
    return base.select("scope", F.lit("q").alias("query_id"), F.lit(text if with_text else None).cast("string").alias("query_text"), (F.col("v") if with_vector else F.lit(None).cast("array<float>")).alias("query_vector"))


def _retrieval_sql(with_text: bool, with_vector: bool, match_all: bool = False, text: str = TEXT) -> str:
    q = f"SELECT scope, arg_min(embedding, id) AS v FROM memories WHERE {USABLE} GROUP BY 1" if with_vector else "SELECT DISTINCT scope, NULL AS v FROM memories"
    lex = "len(list_intersect(qt, ct)) / len(qt)::DOUBLE" if with_text else "0.0"
    sim = COS if with_vector else "0.0"
    where = ["true"] + ([USABLE.replace("embedding", "m.embedding")] if with_vector else []) + (["len(list_intersect(qt, ct)) = len(qt)"] if match_all else [])
    score = f"round({sim} * 0.60 + {lex} * 0.40 + coalesce(m.feedback_score::DOUBLE, 0.0) * 0.05, 6)"
    return f"""WITH q AS ({q}), m AS (SELECT scope, id, embedding, feedback_score, coalesce({terms_sql('content')}, []) AS ct, {terms_sql(chr(39) + text + chr(39))} AS qt FROM memories)
SELECT scope, query_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS place FROM (SELECT m.scope, 'q' AS query_id, m.id, {score} AS score FROM m JOIN q ON q.scope = m.scope WHERE {' AND '.join(where)})) WHERE place <= 5"""


@query("memories_by_text", _retrieval_sql(True, False))
def _(spark, d):
    return memories.retrieve(table(spark, d, "memories"), _queries(spark, d, True, False))


@query("memories_by_all_words", _retrieval_sql(True, False, True, TWO_WORDS))
def _(spark, d):
    return memories.retrieve(table(spark, d, "memories"), _queries(spark, d, True, False, TWO_WORDS), match_all=True)


@query("memories_by_vector", _retrieval_sql(False, True))
def _(spark, d):
    return memories.retrieve(table(spark, d, "memories"), _queries(spark, d, False, True))


@query("memories_hybrid", _retrieval_sql(True, True))
def _(spark, d):
    return memories.retrieve(table(spark, d, "memories"), _queries(spark, d, True, True))


def _rerank_sql() -> str:
    age = f"greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(m.created_at)) / 86400e6)"
    rec = f"CASE WHEN m.created_at IS NULL THEN 0.5 ELSE pow(0.5, {age} / 7.0) END"
    boost = "CASE WHEN lower(m.category) = 'fact' THEN 1.0 WHEN lower(m.category) = 'llm' THEN 0.2 ELSE 0.5 END"
    return f"""WITH h AS ({_retrieval_sql(True, True)}), r AS (SELECT h.scope, h.id, h.place, round(h.score * 0.60 + {rec} * 0.25 + {boost} * 0.15, 6) AS rank_score FROM h JOIN memories m ON m.id = h.id)
SELECT scope, id, rank_score, row_number() OVER (PARTITION BY scope ORDER BY rank_score DESC, place) AS new_place FROM r"""


@query("memories_reranked", _rerank_sql())
def _(spark, d):
    m = table(spark, d, "memories")
    hits = memories.retrieve(m, _queries(spark, d, True, True)).join(m.select("id", "created_at", "category"), "id").withColumnRenamed("score", "base_score")
    return rerank.first_pass(hits, now(), {"fact": 1.0, "llm": 0.2}, group=("scope",)).select("scope", "id", "rank_score", "new_place")


@query("memories_scanned", "SELECT id, scope FROM memories WHERE id > '7f' ORDER BY id LIMIT 1000")
def _(spark, d):
    return memories.scan(table(spark, d, "memories"), "7f")


@query("memories_feedback", f"""WITH a AS (SELECT *, coalesce(len(list_intersect({terms_sql('content')}, {terms_sql(chr(39) + 'choir rehearsal' + chr(39))})) > 0, false) AS m FROM memories),
b AS (SELECT *, m AND row_number() OVER (PARTITION BY scope, m ORDER BY created_at NULLS FIRST, id) <= 10 AS touched FROM a)
SELECT id, touched, CASE WHEN touched THEN greatest(-10.0, least(10.0, coalesce(feedback_score::DOUBLE, 0.0) + 3.0)) ELSE feedback_score::DOUBLE END AS feedback_score FROM b""")
def _(spark, d):
    rows = memories.adjust_feedback(table(spark, d, "memories"), "choir rehearsal", 3.0)
    return rows.select("id", "touched", F.col("feedback_score").cast("double").alias("feedback_score"))


@query("memory_counts", "SELECT scope, count(*) AS n_memories FROM memories GROUP BY 1")
def _(spark, d):
    return memories.counts(table(spark, d, "memories"))


@query("memory_scopes", "SELECT DISTINCT scope FROM memories")
def _(spark, d):
    return memories.scopes(table(spark, d, "memories"))


_DOOMED = "coalesce(created_at < TIMESTAMP '2026-01-01' AND confidence <= 0.7::FLOAT, false)"


def _rule():
    return memories.doomed(older_than=F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), max_confidence=0.7)


@query("memories_prune_dry", f"SELECT scope, count(*) AS n_doomed FROM memories WHERE {_DOOMED} GROUP BY 1")
def _(spark, d):
    return table(spark, d, "memories").where(_rule()).groupBy("scope").agg(F.count(F.lit(1)).alias("n_doomed"))


@query("memories_pruned", f"SELECT id FROM memories WHERE NOT {_DOOMED}")
def _(spark, d):
    return table(spark, d, "memories").where(~_rule()).select("id")


@query("scope_purged", " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n_removed FROM {t} WHERE scope = 't1'" for t in ("memories", "sessions", "turn_traces", "turns", "knowledge_nodes", "knowledge_edges")))
def _(spark, d):
    return memories.purge("t1", **{t: table(spark, d, t) for t in ("memories", "sessions", "turn_traces", "turns", "knowledge_nodes", "knowledge_edges")})[1]


# ---- consolidation

_DOMS = "coalesce({c}, [])"


@query("micro_consolidated", """WITH a AS (SELECT id, coalesce(goal, '') AS g, coalesce(goal_status, '') AS s, upper(coalesce(sentiment, '')) AS m, coalesce(domains, []) AS d, coalesce(pii_types, []) AS p,
 lag(coalesce(goal, '')) OVER w AS pg, lag(coalesce(goal_status, '')) OVER w AS ps, lag(upper(coalesce(sentiment, ''))) OVER w AS pm, coalesce(lag(coalesce(domains, [])) OVER w, []) AS pd
 FROM turns WINDOW w AS (PARTITION BY scope, session_id ORDER BY turn_n NULLS FIRST, id)),
g AS (SELECT * FROM a WHERE g <> '' AND s <> '' AND (pg IS NULL OR pg <> g OR ps <> s))
SELECT id, 'goal_started' AS category, g AS detail, 0.9::DOUBLE AS confidence FROM g WHERE upper(s) = 'NEW'
UNION ALL SELECT id, 'goal_completed', g, 1.0 FROM g WHERE upper(s) = 'COMPLETED'
UNION ALL SELECT id, 'goal_abandoned', g, 0.85 FROM g WHERE upper(s) = 'ABANDONED'
UNION ALL SELECT id, 'sentiment', 'frustrated', 0.7 FROM a WHERE m = 'FRUSTRATED' AND coalesce(pm, '') <> 'FRUSTRATED'
UNION ALL SELECT id, 'pii', array_to_string(p, ', '), 1.0 FROM a WHERE len(p) > 0
UNION ALL SELECT id, 'preference', x, 0.7 FROM (SELECT id, unnest(d) AS x, pd FROM a) WHERE x IS NOT NULL AND x <> '' AND NOT list_contains(pd, x)""")
def _(spark, d):
    return consolidation.micro(table(spark, d, "turns"))


_LIKED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, session_id ORDER BY turn_n DESC NULLS LAST, id DESC) AS n FROM turns WHERE coalesce(feedback, 0) <> -1) WHERE n <= 10)"


@query("transcripts", f"""SELECT scope, session_id, string_agg('Turn ' || coalesce(turn_n::VARCHAR, '?') || ': ' || coalesce(user_input, '') || chr(10) || '  sentiment=' || CASE WHEN coalesce(sentiment, '') = '' THEN 'NEUTRAL' ELSE sentiment END
 || ' domains=[' || array_to_string(list_transform(coalesce(domains, []), lambda x: '''' || x || ''''), ', ') || ']' || CASE WHEN coalesce(goal, '') <> '' THEN ' [goal: ' || goal || ']' ELSE '' END || chr(10) || '  assistant: ' || coalesce(response, ''), chr(10) ORDER BY turn_n NULLS FIRST, id) AS transcript
FROM {_LIKED} GROUP BY 1, 2""")
def _(spark, d):
    return consolidation.transcripts(consolidation.last_liked(table(spark, d, "turns")))


@query("sole_voice", "SELECT scope, session_id, CASE WHEN min(trim(coalesce(voiced_by, ''))) = max(trim(coalesce(voiced_by, ''))) THEN min(trim(coalesce(voiced_by, ''))) ELSE '' END AS voice FROM turns GROUP BY 1, 2")
def _(spark, d):
    return consolidation.sole_voice(table(spark, d, "turns"))


@query("session_summaries", "SELECT scope, session_id, count(*) AS n_turns, count(*) FILTER (WHERE feedback = -1) AS n_disliked, array_to_string(list_sort(list_distinct(flatten(list(coalesce(domains, []))))), ',') AS domains FROM turns GROUP BY 1, 2")
def _(spark, d):
    return consolidation.close_summary(table(spark, d, "turns"))

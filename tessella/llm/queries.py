"""Queries of the llm problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm import conversations, copies, leaks, mojibake, names, personal, tokenizing, vectors
from tessella.sources.tables import table


def p1_found(spark, d):
    return names.same_entity_pairs(table(spark, d, "knowledge_nodes"))


def p1_entities(spark, d):
    return names.entities(table(spark, d, "knowledge_nodes"))


def _fields(spark, d):
    return personal.text_fields(table(spark, d, "turns"), table(spark, d, "memories"))


def p3_found(spark, d):
    return personal.occurrences(_fields(spark, d))


def p3_redacted(spark, d):
    return personal.redacted(_fields(spark, d))


def p5_found(spark, d):
    return copies.copy_pairs(table(spark, d, "memories"))


def p5_collapsed(spark, d):
    return copies.collapse(table(spark, d, "memories"))


def _collections(spark, d):
    return [
        vectors.collection(table(spark, d, "memories"), "memories", F.col("id").cast("string"), "embedding", 64),
        vectors.collection(table(spark, d, "knowledge_nodes"), "knowledge_nodes", F.col("id").cast("string"), "embedding", 64),
        vectors.chunk_collection(table(spark, d, "kb_chunks")),
    ]


def p6_found(spark, d):
    return vectors.similar_pairs(_collections(spark, d))


def p7_found(spark, d):
    return conversations.dropped(table(spark, d, "turns"))


def p7_messages(spark, d):
    return conversations.messages(table(spark, d, "turns"))


def p8_ids(spark, d):
    return tokenizing.encode_corpus(table(spark, d, "documents"))


def p9_found(spark, d):
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_cleaned(spark, d):
    return leaks.without_spans(table(spark, d, "documents"), table(spark, d, "eval_items")).where("n_removed > 0")


def p10_found(spark, d):
    return mojibake.garbled(table(spark, d, "documents"))


def p10_restored(spark, d):
    return mojibake.restored(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p3_found": p3_found, "p3_redacted": p3_redacted, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p6_found": p6_found, "p7_found": p7_found, "p7_messages": p7_messages, "p8_ids": p8_ids, "p9_found": p9_found, "p9_cleaned": p9_cleaned, "p10_found": p10_found, "p10_restored": p10_restored}

_CANON = "regexp_replace(lower(nfc_normalize({c})), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"
_PART = "regexp_full_match(x, '(?s)[\\pP\\pS\\s]*[\\p{L}\\p{N}]+\\s*[:=].*')"
P5_ROWS = f"""
WITH a AS (SELECT id, scope, {_CANON.format(c="coalesce(category, '')")} AS cat, {_CANON.format(c='content')} AS txt,
  list_filter(regexp_split_to_array(content, '[;|\\n\\r]'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS parts FROM memories),
b AS (SELECT *, len(parts) > 1 AND len(list_filter(parts, lambda x: NOT {_PART})) = 0 AS made FROM a WHERE regexp_matches(txt, '[\\p{{L}}\\p{{N}}]')),
t AS (SELECT id, scope, cat, txt, CASE WHEN made THEN array_to_string(list_sort(list_transform(parts, lambda x:
  {_CANON.format(c="regexp_extract(x, '(?s)^([^:=]*)[:=]', 1)")} || ':' || {_CANON.format(c="regexp_extract(x, '(?s)^[^:=]*[:=](.*)$', 1)")})), '|') END AS tup FROM b),
t1 AS (SELECT *, CASE WHEN tup IS NULL THEN txt ELSE min(txt) OVER (PARTITION BY scope, cat, tup) END AS g1 FROM t),
t2 AS (SELECT *, min(g1) OVER (PARTITION BY scope, cat, txt) AS g2 FROM t1),
t3 AS (SELECT *, CASE WHEN tup IS NULL THEN g2 ELSE min(g2) OVER (PARTITION BY scope, cat, tup) END AS g3 FROM t2),
g AS (SELECT id, scope, cat, min(g3) OVER (PARTITION BY scope, cat, txt) AS k FROM t3),
f AS (SELECT id, min(id) OVER (PARTITION BY scope, cat, k) AS first_id FROM g)
"""
_IS_UUID = "regexp_full_match(lower(replace(session_id, '-', '')), '[0-9a-f]{32}')"
_HEX = "lower(replace(session_id, '-', ''))"
_SID = f"CASE WHEN {_IS_UUID} THEN {_HEX}[1:8] || '-' || {_HEX}[9:12] || '-' || {_HEX}[13:16] || '-' || {_HEX}[17:20] || '-' || {_HEX}[21:32] ELSE session_id END"
_BARE = "lower(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_IN = ", ".join(f"'{x}'" for x in ("", *conversations.STAND_INS))
_THERE = f"({_BARE} NOT IN ({_IN.replace('{', '').replace('}', '')}))"
P7_JUDGED = f"""
WITH d AS (SELECT DISTINCT scope, {_SID} AS session_id, turn_n, user_input, response FROM turns WHERE regexp_matches(session_id, '\\S')),
v AS (SELECT scope, session_id, bool_and({_THERE.format(c='user_input')} AND {_THERE.format(c='response')}) AND count(turn_n) = count(*)
  AND count(DISTINCT turn_n) = count(*) AND min(turn_n) = 0 AND max(turn_n) = count(*) - 1 AS kept FROM d GROUP BY 1, 2)
"""
_GRAMS = """(SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT {key}, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM {tbl} WHERE text IS NOT NULL), unnest(range(1, greatest(1, len(w) - 11))) u(i))"""
SQL = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM {_GRAMS.format(key='doc_id', tbl='documents')} JOIN {_GRAMS.format(key='item_id', tbl='eval_items')} USING (g)",
    "p5_found": P5_ROWS + "SELECT first_id, id AS copy_id FROM f WHERE id <> first_id",
    "p5_collapsed": P5_ROWS + "SELECT first_id, count(*) AS n_copies FROM f GROUP BY 1",
    "p7_found": P7_JUDGED + "SELECT scope, session_id FROM v WHERE NOT coalesce(kept, false)",
    "p7_messages": P7_JUDGED
    + """SELECT scope, session_id, turn_n * 2 AS place, 'user' AS role, user_input AS text FROM d SEMI JOIN v ON v.scope IS NOT DISTINCT FROM d.scope AND v.session_id = d.session_id AND v.kept
UNION ALL SELECT scope, session_id, turn_n * 2 + 1, 'assistant', response FROM d SEMI JOIN v ON v.scope IS NOT DISTINCT FROM d.scope AND v.session_id = d.session_id AND v.kept""",
}

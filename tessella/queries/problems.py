"""Queries of the general problems: references to missing records (2) and nested records (4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import orphans, shredding
from tessella.sources.tables import table


def _ledger(spark, d):
    return orphans.ledger(table(spark, d, "turns"), table(spark, d, "knowledge_edges"), table(spark, d, "knowledge_nodes"), table(spark, d, "sessions"))


def p2_found(spark, d):
    return _ledger(spark, d).cases()


def p2_snapshot(spark, d):
    return _ledger(spark, d).snapshot()


def p4_found(spark, d):
    return shredding.object_links(table(spark, d, "turn_traces"))


def p4_tables(spark, d):
    """One row per object, the trace's own included, with its flat table's name and its own scalars."""
    rows = shredding.object_rows(table(spark, d, "turn_traces"), roots=True)
    return rows.withColumn("fields", F.to_json("fields"))


_HEX = "lower(replace({c}, '-', ''))"
_IS = "regexp_full_match(" + _HEX + ", '[0-9a-f]{{32}}')"

P2_FOUND_SQL = f"""
WITH par AS (
  SELECT scope, {_HEX.format(c='id')} AS k, min(coalesce(started_at, TIMESTAMP '0001-01-01 00:00:00')) AS ts
  FROM sessions WHERE {_IS.format(c='id')} GROUP BY 1, 2),
refs AS (
  SELECT 'turns' AS tbl, 'session_id' AS field_name, t.id AS row_id, t.created_at AS ts,
         CASE WHEN p.k IS NULL THEN 'missing' WHEN p.ts > t.created_at THEN 'late' END AS ref_state
  FROM turns t LEFT JOIN par p ON {_IS.format(c='t.session_id')} AND p.k = {_HEX.format(c='t.session_id')} AND p.scope IS NOT DISTINCT FROM t.scope
  WHERE regexp_matches(t.session_id, '\\S')
  UNION ALL
  SELECT 'knowledge_edges', e.f, e.id, e.created_at,
         CASE WHEN n.id IS NULL THEN 'missing' WHEN n.created_at > e.created_at THEN 'late' END
  FROM (SELECT id, created_at, 'source_id' AS f, source_id AS r FROM knowledge_edges
        UNION ALL SELECT id, created_at, 'target_id', target_id FROM knowledge_edges) e
  LEFT JOIN knowledge_nodes n ON n.id = e.r WHERE e.r IS NOT NULL)
SELECT tbl, field_name, strftime(ts, '%Y-%m') AS period_ym, row_id, ref_state FROM refs WHERE ref_state IS NOT NULL
"""

QUERIES = {"p2_found": p2_found, "p2_snapshot": p2_snapshot, "p4_found": p4_found, "p4_tables": p4_tables}
SQL = {
    "p2_found": P2_FOUND_SQL,
    "p2_snapshot": f"SELECT tbl, field_name, period_ym, ref_state, count(*) AS n_refs FROM ({P2_FOUND_SQL}) GROUP BY ALL",
}

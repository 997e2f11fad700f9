"""Queries of the general training-data problems (references and instants)."""

from __future__ import annotations

from brindle.operators.instants import instants, message_values
from brindle.operators.orphans import orphan_report, orphans, store_records, store_references
from brindle.session import table


def _orphans(spark, d):
    chunks = table(spark, d, "chunks")
    return orphans(store_references(chunks, table(spark, d, "contradiction_log")), store_records(table(spark, d, "sources"), chunks))


def p2_found(spark, d):
    return _orphans(spark, d).drop("month")


def p2_report(spark, d):
    return orphan_report(_orphans(spark, d))


def p6_found(spark, d):
    values = message_values(table(spark, d, "sample_messages_for_triage"), table(spark, d, "sent_messages"), table(spark, d, "sample_email_thread"))
    return instants(values, table(spark, d, "channel_clock"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p6_found": p6_found}

_KEY = r"nullif(lower(regexp_replace({}, '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g')), '')"
_ORPHANS = f"""
WITH refs AS (
  SELECT 'chunks' AS ref_table, 'source_id' AS ref_field, chunk_id AS record_id, 'sources' AS target, {_KEY.format("source_id")} AS key, ingested_at AS seen FROM chunks
  UNION ALL SELECT 'contradiction_log', 'chunk_a', CAST(id AS VARCHAR), 'chunks', {_KEY.format("chunk_a")}, detected_at FROM contradiction_log
  UNION ALL SELECT 'contradiction_log', 'chunk_b', CAST(id AS VARCHAR), 'chunks', {_KEY.format("chunk_b")}, detected_at FROM contradiction_log
), records AS (
  SELECT target, key, min(seen) AS first_at FROM (
    SELECT 'sources' AS target, {_KEY.format("source_id")} AS key, coalesce(ingested_at, -1e300) AS seen FROM sources
    UNION ALL SELECT 'chunks', {_KEY.format("chunk_id")}, coalesce(ingested_at, -1e300) FROM chunks
  ) GROUP BY target, key
), found AS (
  SELECT DISTINCT ref_table, ref_field, record_id, strftime(make_timestamp(CAST(floor(seen * 1e6) AS BIGINT)), '%Y-%m') AS month
  FROM refs LEFT JOIN records USING (target, key)
  WHERE key IS NOT NULL AND (first_at IS NULL OR first_at > seen)
)
"""
SQL = {
    "p2_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_field, record_id FROM found",
    "p2_report": _ORPHANS + "SELECT ref_table, ref_field, month, count(*) AS n_orphans, count(DISTINCT record_id) AS n_records FROM found GROUP BY ref_table, ref_field, month",
}

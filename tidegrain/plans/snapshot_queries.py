"""Queries over the periodic full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.operators.snapshots import document_changes, fingerprint_changes
from tidegrain.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    documents = document_changes(table(spark, root, "document_snapshots")).withColumn("entity", F.lit("document"))
    prints = fingerprint_changes(table(spark, root, "fingerprint_records")).withColumn("entity", F.lit("fingerprint"))
    return documents.unionByName(prints).select("entity", "snapshot_no", "record_key", "change_kind")


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
WITH d AS (
  SELECT * FROM (
    SELECT snapshot_no, lower(trim(url, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS record_key, stable_ratio, novelty_ratio, changed_recently,
      row_number() OVER (PARTITION BY snapshot_no, lower(trim(url, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))
        ORDER BY updated_at DESC NULLS LAST, delivered_at DESC NULLS LAST) AS rn
    FROM document_snapshots) WHERE rn = 1 AND record_key <> ''),
f AS (
  SELECT * FROM (
    SELECT snapshot_no, document_id::VARCHAR || '/' || lower(trim(fingerprint, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS record_key, heading_path,
      row_number() OVER (PARTITION BY snapshot_no, document_id, lower(trim(fingerprint, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) ORDER BY saved_at DESC NULLS LAST) AS rn
    FROM fingerprint_records) WHERE rn = 1),
t AS (SELECT unnest([2, 3, 4])::INTEGER AS t)
SELECT 'document' AS entity, t AS snapshot_no, record_key, kind AS change_kind FROM (
  SELECT t, coalesce(n.record_key, o.record_key) AS record_key,
    CASE WHEN o.record_key IS NULL THEN 'added' WHEN n.record_key IS NULL THEN 'removed'
      WHEN n.changed_recently IS DISTINCT FROM o.changed_recently
        OR (n.stable_ratio IS DISTINCT FROM o.stable_ratio AND NOT coalesce(abs(n.stable_ratio - o.stable_ratio) < 1e-6, false))
        OR (n.novelty_ratio IS DISTINCT FROM o.novelty_ratio AND NOT coalesce(abs(n.novelty_ratio - o.novelty_ratio) < 1e-6, false)) THEN 'changed' END AS kind
  FROM (SELECT * FROM t JOIN d ON d.snapshot_no = t.t) n
  FULL JOIN (SELECT * FROM t JOIN d ON d.snapshot_no = t.t - 1) o USING (t, record_key)) WHERE kind IS NOT NULL
UNION ALL
SELECT 'fingerprint', t, record_key, kind FROM (
  SELECT t, coalesce(n.record_key, o.record_key) AS record_key,
    CASE WHEN o.record_key IS NULL THEN 'added' WHEN n.record_key IS NULL THEN 'removed' WHEN n.heading_path IS DISTINCT FROM o.heading_path THEN 'changed' END AS kind
  FROM (SELECT * FROM t JOIN f ON f.snapshot_no = t.t) n
  FULL JOIN (SELECT * FROM t JOIN f ON f.snapshot_no = t.t - 1) o USING (t, record_key)) WHERE kind IS NOT NULL
""",
}

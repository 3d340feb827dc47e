"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.llm import containers, languages, leaks, main_body, near_duplicates, percentiles, repeated_lines, residue, similar_vectors
from tidegrain.runtime import stage
from tidegrain.sources.tables import table


def p2_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return percentiles.percentiles(percentiles.value_counts(percentiles.unique_runs(table(spark, root, "analytics_runs"))))


def p2_by_days(spark: SparkSession, root: str) -> DataFrame:
    return percentiles.percentiles(percentiles.value_counts(percentiles.combine([percentiles.day_parts(table(spark, root, "analytics_runs"))])))


def p2_rounded(spark: SparkSession, root: str) -> DataFrame:
    return percentiles.percentiles(percentiles.value_counts(percentiles.unique_runs(table(spark, root, "analytics_runs")), bits=8))


def _texts(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks").select(F.lit("chunk").alias("entity"), F.col("chunk_no").alias("id"), "text")
    summaries = table(spark, root, "documents").select(F.lit("summary").alias("entity"), F.col("doc_id").alias("id"), F.col("semantic_summary").alias("text"))
    return chunks.unionByName(summaries)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.similar_records(_texts(spark, root))


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.similar_groups(_texts(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    pages = residue.residue_pages(table(spark, root, "raw_pages")).select(F.lit("page").alias("entity"), F.col("page_no").alias("id"))
    titles = residue.residue_titles(table(spark, root, "documents")).select(F.lit("document").alias("entity"), F.col("doc_id").alias("id"))
    return pages.unionByName(titles)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return main_body.not_main_body(table(spark, root, "simplified_nodes"))


def p5_main_texts(spark: SparkSession, root: str) -> DataFrame:
    return main_body.main_texts(table(spark, root, "simplified_nodes"))


def p5_page_bodies(spark: SparkSession, root: str) -> DataFrame:
    return main_body.main_texts(stage(main_body.page_nodes(table(spark, root, "raw_pages"))))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines.found_lines(table(spark, root, "chunks"), table(spark, root, "documents"))


def p6_clean_chunks(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines.clean_chunks(table(spark, root, "chunks"), table(spark, root, "documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "topic_docs").select("vec_id", "vector").unionByName(table(spark, root, "topic_nodes").select("vec_id", "vector"))
    return similar_vectors.similar_pairs(vectors)


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return containers.pack(table(spark, root, "documents"), table(spark, root, "context_budgets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_passages(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return languages.wrong_labels(table(spark, root, "documents"), table(spark, root, "lang_samples"))


def p10_stretches(spark: SparkSession, root: str) -> DataFrame:
    return languages.stretches(table(spark, root, "documents"), table(spark, root, "lang_samples"))


QUERIES = {"p2_percentiles": p2_percentiles, "p2_by_days": p2_by_days, "p2_rounded": p2_rounded, "p8_containers": p8_containers, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p5_found": p5_found, "p5_main_texts": p5_main_texts, "p5_page_bodies": p5_page_bodies, "p6_found": p6_found, "p6_clean_chunks": p6_clean_chunks, "p7_found": p7_found, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_stretches": p10_stretches}

_LINES = r"""
WITH once AS (SELECT DISTINCT chunk_no, doc_id, text FROM chunks WHERE text IS NOT NULL),
pieces AS (SELECT chunk_no, doc_id, string_split(text, chr(10)) AS ls FROM once),
raw AS (SELECT chunk_no, doc_id, unnest(range(1, len(ls) + 1))::INTEGER AS line_no, unnest(ls) AS line FROM pieces),
keyed AS (SELECT chunk_no, doc_id, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[\s\pZ\x{1c}-\x{1f}\x{85}\x0b]+', ' ', 'g')) AS key FROM raw),
hosted AS (SELECT k.*, lower(trim(d.host)) AS host FROM keyed k JOIN documents d ON d.doc_id = k.doc_id WHERE key <> '' AND trim(d.host) <> ''),
many AS (SELECT host, key FROM hosted GROUP BY host, key HAVING count(DISTINCT doc_id) >= 5),
hits AS (SELECT DISTINCT chunk_no, line_no FROM hosted JOIN many USING (host, key))
"""

_PERCENTILES = """
WITH once AS (SELECT * FROM (
  SELECT run_id, completed_at, nullif(trim(operation), '') AS operation, nullif(trim(lower(host)), '') AS host, latency_ms, packet_bytes,
    row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC NULLS LAST, started_at DESC NULLS LAST, latency_ms DESC NULLS LAST, packet_bytes DESC NULLS LAST) AS rn
  FROM analytics_runs WHERE run_id IS NOT NULL) WHERE rn = 1),
readings AS (
  SELECT operation, host, 'latency_ms' AS metric, {latency} AS value FROM once WHERE latency_ms >= 0
  UNION ALL SELECT operation, host, 'packet_bytes', {bytes} FROM once WHERE packet_bytes >= 0),
scoped AS (
  SELECT 'operation' AS scope, operation, '' AS host, metric, value FROM readings WHERE operation IS NOT NULL
  UNION ALL SELECT 'host', '', host, metric, value FROM readings WHERE host IS NOT NULL
  UNION ALL SELECT 'operation_host', operation, host, metric, value FROM readings WHERE operation IS NOT NULL AND host IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, operation, host, metric ORDER BY value) AS r, count(*) OVER (PARTITION BY scope, operation, host, metric) AS n FROM scoped)
SELECT scope, operation, host, metric, percent, value::BIGINT AS value, n FROM ranked
JOIN (SELECT unnest([50, 90, 95, 99])::INTEGER AS percent) ON r = greatest(1, (n * percent + 99) // 100)
"""
_ROUND = "(({0} >> greatest(0, (floor(log2(greatest({0}, 1)))::INTEGER - 7))) << greatest(0, (floor(log2(greatest({0}, 1)))::INTEGER - 7)))"

_SIMILAR = r"""
WITH RECURSIVE texts AS (
  SELECT 'chunk' AS entity, chunk_no AS id, text FROM chunks UNION
  SELECT 'summary', doc_id, semantic_summary FROM documents),
sets AS (SELECT entity, id, list_distinct(regexp_extract_all(lower(text), '[\pL\pN]+')) AS ws FROM texts WHERE text IS NOT NULL),
big AS (SELECT * FROM sets WHERE len(ws) >= 20),
words AS (SELECT entity, id, len(ws) AS n, unnest(ws) AS w FROM big),
similar_texts AS (SELECT entity, id_a, id_b FROM (
  SELECT a.entity, a.id AS id_a, b.id AS id_b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM words a JOIN words b ON a.entity = b.entity AND a.w = b.w AND a.id < b.id GROUP BY a.entity, a.id, b.id)
WHERE shared >= 0.8 * (na + nb - shared) - 1e-9)
"""

SQL = {
    "p2_percentiles": _PERCENTILES.format(latency="latency_ms", bytes="packet_bytes"),
    "p2_by_days": _PERCENTILES.format(latency="latency_ms", bytes="packet_bytes"),
    "p2_rounded": _PERCENTILES.format(latency=_ROUND.format("latency_ms"), bytes=_ROUND.format("packet_bytes")),
    "p6_found": _LINES + "SELECT chunk_no, line_no FROM hits",
    "p6_clean_chunks": _LINES + """,
gone AS (SELECT chunk_no, list(line_no) AS nos FROM hits GROUP BY chunk_no),
texts AS (SELECT chunk_no, text FROM (SELECT chunk_no, text, row_number() OVER (PARTITION BY chunk_no ORDER BY text DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)
SELECT t.chunk_no, len(coalesce(nos, []))::INTEGER AS removed_lines,
  array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(coalesce(nos, []), i::INTEGER)), chr(10)) AS text
FROM texts t LEFT JOIN gone g ON g.chunk_no = t.chunk_no
""",
    "p3_found": _SIMILAR + "SELECT * FROM similar_texts",
    "p3_groups": _SIMILAR + """,
links AS (SELECT entity, id_a AS id, id_b AS other FROM similar_texts UNION ALL SELECT entity, id_b, id_a FROM similar_texts),
reach AS (SELECT DISTINCT entity, id, id AS seen FROM links UNION SELECT r.entity, r.id, l.other FROM reach r JOIN links l ON l.entity = r.entity AND l.id = r.seen),
least AS (SELECT entity, id, min(seen) AS group_id FROM reach GROUP BY entity, id)
SELECT entity, id, any_value(group_id) AS group_id, count(*) AS links FROM links JOIN least USING (entity, id) GROUP BY entity, id
""",
}

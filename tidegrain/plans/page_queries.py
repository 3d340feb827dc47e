"""Queries from pages and chunks: nodes, links, segments, ranking, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.functions import text as T
from tidegrain.functions.values import content_id
from tidegrain.operators import packets, pages, ranking
from tidegrain.sources.tables import table


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "raw_pages").select("page_no", "url", "html", "content_type")


def h01_unpruned_nodes(spark: SparkSession, root: str) -> DataFrame:
    """All nodes that bear text, of the pages that have an article."""
    known = table(spark, root, "simplified_nodes").select("page_no").distinct()
    found = pages.nodes(_pages(spark, root), None).join(known, "page_no", "left_semi")
    return found.select("page_no", "pos", "path", "tag", "kind", T.one_line(F.col("text")).alias("text"), "depth", "heading_level").distinct()


def h01_nodes(spark: SparkSession, root: str) -> DataFrame:
    return pages.nodes(_pages(spark, root)).distinct()


def h01_aggressive_nodes(spark: SparkSession, root: str) -> DataFrame:
    return pages.nodes(_pages(spark, root), "aggressive").distinct()


def h08_titles(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).where("html IS NOT NULL").select("page_no", pages.title_by_pattern(F.col("html")).alias("title")).distinct()


def h13_substrates(spark: SparkSession, root: str) -> DataFrame:
    return _pages(spark, root).where("html IS NOT NULL").select("page_no", pages.substrate(F.col("html"), F.col("content_type")).alias("substrate")).distinct()


def h16_signals(spark: SparkSession, root: str) -> DataFrame:
    """Signals of the pages' node lists, each node once."""
    once = table(spark, root, "simplified_nodes").groupBy("page_no", "pos").agg(F.max("text").alias("text"), F.max("kind").alias("kind"), F.max("path").alias("path"))
    found = pages.signals(once)
    return found.withColumns({c: F.round(c, 6) for c in ("short_text_ratio", "heading_ratio")})


def h17_links(spark: SparkSession, root: str) -> DataFrame:
    return pages.page_links(_pages(spark, root))


def h18_identities(spark: SparkSession, root: str) -> DataFrame:
    return pages.page_identities(_pages(spark, root))


def h20_segments(spark: SparkSession, root: str) -> DataFrame:
    return pages.segments(_pages(spark, root)).distinct()


def s04_within_limits(spark: SparkSession, root: str) -> DataFrame:
    """Pages by what keeps them from being read: size, type or scheme."""
    rows = table(spark, root, "raw_pages")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    allowed = (kind == "") | kind.rlike("text/(html|plain|markdown)|application/(xhtml\\+xml|json|xml)|text/xml")
    verdict = F.when(~F.lower("url").rlike("^https?://"), "scheme").when(F.octet_length("html") > 4_000_000, "size").when(~allowed, "type").otherwise("read")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count_distinct("page_no").alias("pages"))


def s09_text_blocks(spark: SparkSession, root: str) -> DataFrame:
    return pages.text_blocks(table(spark, root, "documents"))


def s09_line_blocks(spark: SparkSession, root: str) -> DataFrame:
    return pages.line_blocks(table(spark, root, "documents"))


def ranked_chunk_rows(spark: SparkSession, root: str) -> DataFrame:
    """Chunks as a ranked table: the group is the document, one node each."""
    once = table(spark, root, "chunks").groupBy("chunk_no").agg(F.max(F.struct("doc_id", "text", "heading_path", "context_alignment")).alias("c")).select("chunk_no", "c.*")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) - 1
    return once.where("text IS NOT NULL").select(
        "chunk_no", "doc_id", place.alias("idx"), F.lit("paragraph").alias("kind"), "heading_path", "text", F.array(F.lit("/p[1]")).alias("node_paths"), F.col("context_alignment").alias("alignment"),
        F.lit(True).alias("kind_match"), F.lit(False).alias("heading_backed"), F.lit(False).alias("embedded"), F.lit(3.0).alias("mean_depth"),
    )


def pack03_chunk_scores(spark: SparkSession, root: str) -> DataFrame:
    rows = ranking.scored(ranked_chunk_rows(spark, root), "doc_id")
    return rows.select("chunk_no", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def pack05_weights(spark: SparkSession, root: str) -> DataFrame:
    """What each chunk looks like: menu, anchor, fragment, index, code."""
    rows = ranking.scored(ranked_chunk_rows(spark, root), "doc_id")
    text, depth, paths = F.col("text"), F.col("depth"), F.col("n_paths")
    r = lambda c, name: F.round(c, 6).alias(name)
    return rows.select(
        "chunk_no", r(ranking.boilerplate_weight(text, depth, paths), "boilerplate"), r(ranking.anchor_weight(text, depth, paths), "anchor"), r(ranking.fragment_weight(text, depth, paths, F.lit(False)), "fragment"),
        r(ranking.index_weight(text, depth, paths), "index_like"), r(ranking.code_weight(text, paths), "code_like"),
    )


def pack06_ranked_chunks(spark: SparkSession, root: str) -> DataFrame:
    rows = ranking.ranked(ranked_chunk_rows(spark, root), "doc_id")
    return rows.select("chunk_no", "doc_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "rank")


def pack11_selected_chunks(spark: SparkSession, root: str) -> DataFrame:
    rows = ranking.selected(ranking.ranked(ranked_chunk_rows(spark, root), "doc_id"), "tiny")
    return rows.select("doc_id", "chunk_no", "rank")


def pack13_deduplicated_chunks(spark: SparkSession, root: str) -> DataFrame:
    rows = ranking.ranked(ranked_chunk_rows(spark, root), "doc_id").withColumn("stable", F.lit(False))
    return ranking.deduplicated(rows.select("doc_id", "chunk_no", "text", "rank", "stable"), "doc_id").select("doc_id", "chunk_no")


def pack16_stability(spark: SparkSession, root: str) -> DataFrame:
    """Per document and snapshot: how many of its fingerprints were there before."""
    rows = table(spark, root, "fingerprint_records").select("snapshot_no", "document_id", F.lower(F.trim("fingerprint")).alias("fp")).distinct()
    before = rows.select((F.col("snapshot_no") + 1).alias("snapshot_no"), "document_id", "fp", F.lit(1).alias("known"))
    joined = rows.join(before, ["snapshot_no", "document_id", "fp"], "left")
    counted = joined.groupBy("snapshot_no", "document_id").agg(F.count("*").alias("prints"), F.count("known").alias("stable"))
    kind = F.when(F.col("stable") == F.col("prints"), "stable").when(F.col("stable") == 0, "changed").otherwise("mixed")
    return counted.select("*", (F.col("prints") - F.col("stable")).alias("novel"), kind.alias("delta_class"))


def pack17_outlines(spark: SparkSession, root: str) -> DataFrame:
    rows = ranked_chunk_rows(spark, root).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "heading_path"))).alias("c"))
    labels = ranking.outline(F.transform("c", lambda x: F.coalesce(x["heading_path"], F.array().cast("array<string>"))))
    return rows.select("doc_id", F.array_join(labels, " | ").alias("outline"))


def pack23_ambiguity(spark: SparkSession, root: str) -> DataFrame:
    rows = ranking.scored(ranked_chunk_rows(spark, root), "doc_id").withColumn("ambiguity", ranking.ambiguity())
    return rows.select("chunk_no", F.round("ambiguity", 6).alias("ambiguity"), ranking.lane(F.col("ambiguity"), "standard").alias("lane"), ranking.lane(F.col("ambiguity"), "tiny").alias("tiny_lane"), F.array_join(ranking.risk_flags(F.col("ambiguity")), ",").alias("flags"))


def pack25_ambiguity_routes(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that a further look is asked for, by document."""
    rows = ranking.ranked(ranked_chunk_rows(spark, root), "doc_id").withColumn("ambiguity", ranking.ambiguity())
    rows = rows.withColumn("lane", ranking.lane(F.col("ambiguity"), "standard")).withColumn("flags", ranking.risk_flags(F.col("ambiguity")))
    return ranking.ambiguity_routes(rows, "doc_id").select("doc_id", "chunk_no", "rank")


def pack24_page_classes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select(ranking.page_class(F.col("url")).alias("page_type"), "doc_id")
    return rows.groupBy("page_type").agg(F.count("*").alias("documents"))


def pack28_utility(spark: SparkSession, root: str) -> DataFrame:
    return ranked_chunk_rows(spark, root).select("chunk_no", F.round(ranking.utility(F.col("text"), F.size("heading_path")), 6).alias("utility"))


def pack31_uncertainty(spark: SparkSession, root: str) -> DataFrame:
    rows = ranking.scored(ranked_chunk_rows(spark, root), "doc_id").groupBy("doc_id").agg(F.max("confidence").alias("confidence"), F.avg((F.octet_length("text") < 48).cast("double")).alias("short"))
    reasons = ranking.uncertainty(F.col("confidence"), F.lit(0.1), F.col("short"), F.lit(0))
    return rows.select("doc_id", F.array_join(reasons, ",").alias("reasons"), ranking.level(reasons).alias("level"))


def v01_proofs(spark: SparkSession, root: str) -> DataFrame:
    rows = ranked_chunk_rows(spark, root)
    made = packets.proof(content_id("chk", F.col("chunk_no")), F.col("node_paths"), F.col("text"))
    return rows.select("chunk_no", made.alias("p")).select("chunk_no", "p.proof_id", "p.source", "p.start", F.col("p.end").alias("stop"))


def flagship_packets(spark: SparkSession, root: str) -> DataFrame:
    """Pages to packets: the whole way."""
    return packets.packets(_pages(spark, root))


def packet_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of html against bytes of packet, per page type."""
    made = packets.packets(_pages(spark, root)).select("page_no", "page_type", "packet_bytes", "chunk_count")
    raw = _pages(spark, root).groupBy("page_no").agg(F.max(F.octet_length("html")).alias("raw_bytes"))
    return made.join(raw, "page_no").groupBy("page_type").agg(F.count("*").alias("pages"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("packet_bytes").alias("packet_bytes"), F.sum(F.greatest(F.col("raw_bytes") - F.col("packet_bytes"), F.lit(0))).alias("saved"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_packets, packet_sizes, h01_aggressive_nodes, h01_nodes, h01_unpruned_nodes, h08_titles, h13_substrates, h16_signals, h17_links, h18_identities, h20_segments, s04_within_limits, s09_line_blocks, s09_text_blocks,
        pack03_chunk_scores, pack05_weights, pack06_ranked_chunks, pack11_selected_chunks, pack13_deduplicated_chunks, pack16_stability, pack17_outlines, pack23_ambiguity, pack24_page_classes, pack25_ambiguity_routes, pack28_utility, pack31_uncertainty, v01_proofs,
    )
}


_WS = r"[\s\x{0b}\x{85}\pZ]+"
_CHUNKS = rf"""
WITH once AS (SELECT * FROM (SELECT chunk_no, doc_id, text, heading_path, context_alignment AS alignment,
    row_number() OVER (PARTITION BY chunk_no ORDER BY doc_id DESC, text DESC) AS rn FROM chunks) WHERE rn = 1 AND text IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS total, len(heading_path) AS depth,
  trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS one FROM once),
f AS (SELECT *, list_filter(string_split(one, ' '), lambda x: x <> '') AS ws, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls,
  len(text) - len(translate(text, '.!?;:', '')) AS marks FROM c),
m AS (SELECT *, CASE WHEN len(ls) > 0 THEN list_sum(list_transform(ls, lambda x: len(x))) / len(ls) ELSE 0 END AS line_mean,
  CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: strlen(x))) / len(ws) ELSE 0 END AS word_mean,
  CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: len(x) <= 32)) / len(ls) ELSE 0 END AS short_share FROM f),
s AS (SELECT *, least(greatest(0.80::DOUBLE + CASE WHEN depth > 0 THEN 0.05 ELSE 0 END + CASE WHEN total > 1 THEN (total - idx - 1)::DOUBLE / (total - 1) * 0.08 ELSE 0 END + alignment * 0.18
    + CASE WHEN strlen(text) > 60 THEN 0.03 ELSE 0 END + 0.05 + 0.02, 0), 1) AS score,
  least(greatest(0.85::DOUBLE + CASE WHEN depth > 0 THEN 0.04 ELSE 0 END + CASE WHEN alignment > 0.45 THEN 0.06 ELSE 0 END + CASE WHEN strlen(text) > 40 THEN 0.04 ELSE 0 END, 0), 0.99) AS confidence FROM m),
w AS (SELECT *,
  CASE WHEN trim(text) <> '' AND strlen(trim(text)) <= 220 AND len(ws) >= 5 AND marks = 0 AND depth < 2 THEN least(CASE WHEN word_mean <= 9 THEN 0.25 ELSE 0 END
    + CASE WHEN len(list_filter(list_transform(ws, lambda x: regexp_replace(x, '^[\[\](){{}}<>"''`,]+|[\[\](){{}}<>"''`,]+$', '', 'g')), lambda x: len(x) > 1 AND (regexp_matches(x, '^[A-Z]') OR (regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))))) / len(ws) >= 0.7 THEN 0.20 ELSE 0 END, 1) ELSE 0 END::DOUBLE AS boilerplate,
  (CASE WHEN strlen(text) >= 140 THEN 0.35 ELSE 0 END + CASE WHEN marks >= 2 THEN 0.30 ELSE 0 END + 0.15 + CASE WHEN depth > 0 THEN 0.10 ELSE 0 END + CASE WHEN line_mean >= 48 THEN 0.15 ELSE 0 END)::DOUBLE AS anchor,
  CASE WHEN len(trim(text)) BETWEEN 60 AND 180 THEN least(CASE WHEN depth >= 3 THEN 0.40 WHEN depth = 2 THEN 0.18 ELSE 0 END + 0.25 + CASE WHEN line_mean >= 70 THEN 0.15 ELSE 0 END + CASE WHEN marks <= 2 THEN 0.10 ELSE 0 END + CASE WHEN depth >= 3 THEN 0.10 ELSE 0 END, 1) ELSE 0 END::DOUBLE AS fragment,
  CASE WHEN trim(text) <> '' AND strlen(trim(text)) <= 1600 THEN least(CASE WHEN short_share >= 0.65 THEN 0.35 ELSE 0 END + CASE WHEN marks = 0 THEN 0.15 ELSE 0 END + CASE WHEN line_mean <= 28 THEN 0.15 ELSE 0 END + CASE WHEN depth <= 2 THEN 0.05 ELSE 0 END, 1) ELSE 0 END::DOUBLE AS index_like,
  CASE WHEN trim(text) <> '' AND strlen(trim(text)) <= 420 THEN least(
      CASE WHEN len(list_filter(ls, lambda l: len(list_filter(list_transform(list_filter(string_split(trim(regexp_replace(l, '{_WS}', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: regexp_replace(x, '^["''`,]+|["''`,]+$', '', 'g')),
          lambda x: regexp_matches(x, '[_0-9-]') OR (regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))) >= 0.5 * len(list_filter(string_split(trim(regexp_replace(l, '{_WS}', ' ', 'g')), ' '), lambda x: x <> ''))
          AND len(list_filter(string_split(trim(regexp_replace(l, '{_WS}', ' ', 'g')), ' '), lambda x: x <> '')) > 0)) >= 0.45 * len(ls) AND len(ls) > 0 THEN 0.40 ELSE 0 END
    + CASE WHEN len(ls) > 0 AND len(list_filter(ls, lambda l: regexp_matches(l, '[_=:`{{}}\[\]();\\]'))) >= 0.5 * len(ls) THEN 0.25 ELSE 0 END
    + CASE WHEN marks = 0 THEN 0.10 ELSE 0 END + CASE WHEN line_mean <= 36 THEN 0.10 ELSE 0 END + 0.05, 1) ELSE 0 END::DOUBLE AS code_like FROM s)
"""


def _demoted(before: str, after: str, weight: str, least: float, fixed: float, share: float, aligned: bool) -> str:
    """SQL of one demotion against the strongest anchor of a document."""
    better = "AND NOT alignment >= b.alignment + 0.08" if aligned else ""
    return f"""
, {after}_b AS (SELECT doc_id, arg_max(chunk_no, (anchor, score, -idx)) FILTER (anchor >= 0.60) AS best FROM {before} GROUP BY doc_id),
{after}_a AS (SELECT x.doc_id, x.chunk_no, x.anchor, x.score, x.alignment FROM {before} x JOIN {after}_b ON x.chunk_no = best),
{after} AS (SELECT d.* EXCLUDE (act) REPLACE (CASE WHEN act THEN least(greatest(d.score - {fixed} - {weight} * {share}, 0), 1) ELSE d.score END AS score, CASE WHEN act THEN least(greatest(d.confidence - {weight} * 0.05, 0), 0.99) ELSE d.confidence END AS confidence)
  FROM (SELECT x.*, coalesce(b.anchor >= 0.70 AND b.score >= 0.82 AND total > 1 AND x.chunk_no <> b.chunk_no AND {weight} >= {least} {better.replace('alignment >=', 'x.alignment >=')}, false) AS act FROM {before} x LEFT JOIN {after}_a b ON b.doc_id = x.doc_id) d)"""


_RANKED = (
    _CHUNKS
    + ", d0 AS (SELECT * REPLACE (CASE WHEN boilerplate > 0 THEN least(greatest(score - boilerplate * 0.28, 0), 1) ELSE score END AS score, CASE WHEN boilerplate > 0 THEN least(greatest(confidence - boilerplate * 0.10, 0), 0.99) ELSE confidence END AS confidence) FROM w)"
    + _demoted("d0", "d1", "fragment", 0.60, 0.18, 0.12, False)
    + _demoted("d1", "d2", "index_like", 0.55, 0.16, 0.14, True)
    + _demoted("d2", "d3", "code_like", 0.55, 0.18, 0.16, True)
    + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx)::INTEGER AS rank FROM d3)"
)
_CLEAN = rf"trim(regexp_replace(regexp_replace(regexp_replace(one, '[\p{{Cc}}\p{{Cf}}]', '', 'g'), '\s+([,.:;!?])', '\1', 'g'), ' +', ' ', 'g'))"
_AMBIGUITY = "least(greatest((CASE WHEN confidence < 0.78 THEN 0.30 ELSE 0 END + CASE WHEN alignment < 0.5 THEN 0.28 ELSE 0 END + CASE WHEN depth = 0 THEN 0.10 ELSE 0 END + CASE WHEN strlen(text) < 48 THEN 0.12 ELSE 0 END + CASE WHEN score < 0.75 THEN 0.10 ELSE 0 END)::DOUBLE, 0), 1)"
_LANE = "CASE WHEN ambiguity >= 0.85 OR (1 - alignment >= 0.90 AND confidence < 0.70) THEN 2 WHEN ambiguity > 0.37 OR 1 - alignment > 0.15 THEN 1 ELSE 0 END"

SQL = {
    "h01_unpruned_nodes": rf"SELECT DISTINCT page_no, pos, path, tag, CASE WHEN tag IN ('p', 'blockquote') THEN 'paragraph' WHEN tag = 'li' THEN 'list_item' WHEN tag IN ('td', 'th') THEN 'table_cell' WHEN tag IN ('pre', 'code') THEN 'code' ELSE 'heading' END AS kind, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS text, depth, heading_level FROM simplified_nodes",
    "h08_titles": rf"SELECT DISTINCT page_no, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_WS}', ' ', 'g')) AS title FROM raw_pages WHERE html IS NOT NULL",
    "h13_substrates": "SELECT DISTINCT page_no, CASE WHEN NOT (coalesce(trim(content_type), '') = '' OR regexp_matches(lower(content_type), 'text/html|application/xhtml\\+xml')) THEN 'plain_text' WHEN regexp_matches(lower(html), 'window\\._a2s|__next_data__|__nuxt__|__apollo_state__|<app-root|data-reactroot') THEN 'embedded_app_payload' WHEN regexp_matches(lower(html), 'wp-content|wp-json|wp-includes|et_pb|elementor|swiper|gsap') THEN 'theme_heavy_wordpress' ELSE 'generic_content' END AS substrate FROM raw_pages WHERE html IS NOT NULL",
    "h16_signals": "WITH o AS (SELECT page_no, pos, max(text) AS text, max(kind) AS kind, max(path) AS path FROM simplified_nodes GROUP BY page_no, pos) SELECT page_no, count(*) AS node_count, round(avg((strlen(trim(text)) < 48)::INT), 6) AS short_text_ratio, round(avg((kind = 'heading')::INT), 6) AS heading_ratio, count(*) FILTER (path LIKE '/embedded/%') AS embedded_count FROM o WHERE trim(text) <> '' GROUP BY page_no",
    "h17_links": rf"""
WITH p AS (SELECT DISTINCT page_no, url, html FROM raw_pages WHERE html IS NOT NULL),
l AS (SELECT page_no, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM p)
SELECT DISTINCT page_no, url, regexp_extract(url, '^https?://[^/]+') || href AS target, trim(regexp_replace(replace(label, '&nbsp;', ' '), '{_WS}', ' ', 'g')) AS label FROM l""",
    "s04_within_limits": "SELECT CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' WHEN strlen(html) > 4000000 THEN 'size' WHEN NOT (coalesce(content_type, '') = '' OR regexp_matches(lower(content_type), 'text/(html|plain|markdown)|application/(xhtml\\+xml|json|xml)|text/xml')) THEN 'type' ELSE 'read' END AS verdict, count(DISTINCT page_no) AS pages FROM raw_pages GROUP BY 1",
    "s09_text_blocks": rf"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS block, unnest(range(len(string_split(text, chr(10) || chr(10)))))::INTEGER AS pos FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, pos, trim(regexp_replace(block, '{_WS}', ' ', 'g')) AS block FROM p) SELECT * FROM o WHERE block <> ''",
    "s09_line_blocks": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, ls, unnest(range((len(ls) - 1) // 32 + 1))::INTEGER AS pos FROM l) SELECT doc_id, pos, array_to_string(ls[pos * 32 + 1 : pos * 32 + 32], chr(10)) AS block FROM i",
    "pack03_chunk_scores": _CHUNKS + "SELECT chunk_no, round(score, 6) AS score, round(confidence, 6) AS confidence FROM s",
    "pack05_weights": _CHUNKS + "SELECT chunk_no, round(boilerplate, 6) AS boilerplate, round(anchor, 6) AS anchor, round(fragment, 6) AS fragment, round(index_like, 6) AS index_like, round(code_like, 6) AS code_like FROM w",
    "pack06_ranked_chunks": _RANKED + "SELECT chunk_no, doc_id, round(score, 6) AS score, round(confidence, 6) AS confidence, rank FROM ranked",
    "pack11_selected_chunks": _RANKED + "SELECT doc_id, chunk_no, rank FROM ranked WHERE rank <= 2",
    "pack16_stability": """
WITH r AS (SELECT DISTINCT snapshot_no, document_id, lower(trim(fingerprint)) AS fp FROM fingerprint_records),
g AS (SELECT a.snapshot_no, a.document_id, count(*) AS prints, count(b.fp) AS stable FROM r a LEFT JOIN r b ON b.snapshot_no = a.snapshot_no - 1 AND b.document_id = a.document_id AND b.fp = a.fp GROUP BY 1, 2)
SELECT *, prints - stable AS novel, CASE WHEN stable = prints THEN 'stable' WHEN stable = 0 THEN 'changed' ELSE 'mixed' END AS delta_class FROM g""",
    "pack23_ambiguity": _CHUNKS + f", a AS (SELECT *, {_AMBIGUITY} AS ambiguity FROM s), l AS (SELECT *, {_LANE} AS lane FROM a) SELECT chunk_no, round(ambiguity, 6) AS ambiguity, lane, CASE WHEN lane >= 2 OR ambiguity >= 0.60 THEN 3 ELSE lane END AS tiny_lane, array_to_string(list_filter([CASE WHEN 1 - alignment > 0.50 THEN 'coverage_gap' END, CASE WHEN ambiguity > 0.50 THEN 'high_ambiguity' END, CASE WHEN depth = 0 THEN 'missing_heading_context' END, CASE WHEN strlen(text) < 48 THEN 'short_segment' END], lambda x: x IS NOT NULL), ',') AS flags FROM l",
    "pack25_ambiguity_routes": _RANKED + f""", a AS (SELECT *, {_AMBIGUITY} AS ambiguity FROM ranked), l AS (SELECT *, {_LANE} AS lane, (ambiguity > 0.50 OR 1 - alignment > 0.50) AS strict FROM a),
top AS (SELECT doc_id, score AS s1, confidence AS c1, strict AS strict1 FROM l WHERE rank = 1),
g AS (SELECT l.*, s1, c1, strict1 FROM l JOIN top USING (doc_id)),
settled AS (SELECT doc_id, (any_value(c1) >= 0.88 AND any_value(s1) >= 0.90 AND NOT any_value(strict1) AND NOT bool_or(rank > 1 AND strict))
  OR (any_value(c1) >= 0.90 AND any_value(s1) >= 0.92 AND NOT any_value(strict1) AND NOT bool_or(rank > 1 AND ((score >= s1 - 0.05 AND confidence >= c1 - 0.05) OR (strict AND score >= s1 - 0.08)))) OR bool_or(confidence >= 0.86 AND score >= 0.86 AND NOT strict) AS done FROM g GROUP BY doc_id),
asking AS (SELECT doc_id, chunk_no, rank, count(*) OVER (PARTITION BY doc_id) AS n FROM g JOIN settled USING (doc_id) WHERE NOT done AND (confidence < 0.80 OR score < 0.84 OR strict))
SELECT doc_id, chunk_no, rank FROM asking WHERE n >= 2""",
    "pack24_page_classes": "SELECT CASE WHEN lower(url) LIKE '%forum%' OR lower(url) LIKE '%thread%' THEN 'forum' WHEN lower(url) LIKE '%api%' OR lower(url) LIKE '%docs%' THEN 'docs' ELSE 'article' END AS page_type, count(*) AS documents FROM documents GROUP BY 1",
    "pack28_utility": _CHUNKS + f""", u AS (SELECT chunk_no, depth, {_CLEAN} AS t FROM m),
x AS (SELECT *, len(t) AS size, len(t) - len(translate(t, '.!?;:', '')) AS n, list_filter(string_split(t, ' '), lambda x: x <> '') AS tw FROM u)
SELECT chunk_no, round(CASE WHEN t = '' THEN 0 ELSE least(greatest((CASE WHEN size BETWEEN 180 AND 700 THEN 0.42 WHEN size >= 100 THEN 0.28 WHEN size >= 60 THEN 0.16 ELSE 0.06 END + CASE depth WHEN 0 THEN 0.02 WHEN 1 THEN 0.14 WHEN 2 THEN 0.08 ELSE 0.02 END
  + CASE WHEN n >= 2 THEN 0.20 WHEN n = 1 THEN 0.12 ELSE 0 END + CASE WHEN size >= 48 THEN 0.10 ELSE 0 END - CASE WHEN depth >= 3 AND size <= 180 THEN 0.22 ELSE 0 END
  - CASE WHEN n = 0 AND depth <= 1 AND size BETWEEN 60 AND 180 AND len(tw) >= 8 AND list_sum(list_transform(tw, lambda x: len(x))) / len(tw) <= 10 THEN 0.26 ELSE 0 END)::DOUBLE, 0), 1) END, 6) AS utility FROM x""",
    "pack31_uncertainty": _CHUNKS + """, g AS (SELECT doc_id, max(confidence) AS confidence, avg((strlen(text) < 48)::INT) AS short FROM s GROUP BY doc_id),
r AS (SELECT doc_id, list_filter([CASE WHEN confidence > 0 AND confidence < 0.72 THEN 'low_top_chunk_confidence' END, CASE WHEN confidence >= 0.72 AND confidence < 0.84 THEN 'moderate_top_chunk_confidence' END, 'weak_heading_structure', CASE WHEN short >= 0.88 THEN 'fragmented_page_surface' END], lambda x: x IS NOT NULL) AS reasons FROM g)
SELECT doc_id, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'low' WHEN len(reasons) <= 2 THEN 'medium' ELSE 'high' END AS level FROM r""",
    "v01_proofs": _CHUNKS + "SELECT chunk_no, 'proof_' || substr(sha256('chk_' || substr(sha256(chunk_no::VARCHAR), 1, 16) || chr(0) || '/p[1]' || chr(0) || strlen(text)::VARCHAR), 1, 16) AS proof_id, '/p[1]' AS source, 0 AS start, strlen(text)::INTEGER AS stop FROM c",
}

"""DuckDB SQL of the queries over the document memory."""

from __future__ import annotations

_WS = r"[\s\x{0b}\x{85}\pZ]+"


def _one(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _fields(x: str) -> str:
    return f"list_filter(string_split({_one(x)}, ' '), lambda x: x <> '')"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: x <> '')"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda x: {_one('x')}), lambda x: x <> '')"


def _alnum(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _first_distinct(x: str) -> str:
    """Distinct entries of a list in the order of their first places."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _tokens(x: str) -> str:
    long = f"list_filter(string_split({_alnum(x)}, ' '), lambda x: len(x) >= 3)"
    return _first_distinct(long)


def _head(x: str, n: int) -> str:
    return f"CASE WHEN len({_one(x)}) <= {n} THEN {_one(x)} ELSE rtrim(regexp_replace(substr({_one(x)}, 1, {n}), '\\s+\\S*$', '')) END"


def _host(u: str) -> str:
    return f"lower(nullif(regexp_extract({u}, '(?i)^\\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), ''))"


def _path(u: str) -> str:
    p = f"trim(regexp_extract({u}, '(?i)^\\s*[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


_ALL = f"(SELECT DISTINCT url, {_host('url')} AS host, {_path('url')} AS path FROM documents)"
_PARTS = f"""u AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1 - regexp_matches(host, '\\.(ac|co|com|edu|gob|gouv|gov|govt|go|id|ind|info|ltd|me|mil|ne|net|nhs|nic|nom|or|org|plc|sch)\\.[^.]{{2}}$')::INTEGER, 1), len(string_split(host, '.'))), '.') AS family,
  lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM {_ALL})"""
_SEGMENT = "CASE WHEN regexp_matches(s, '^[0-9]+$') THEN -0.08 ELSE CASE WHEN strlen(s) >= 18 AND len(s) - len(replace(s, '-', '')) >= 2 THEN -0.08 ELSE 0 END + CASE WHEN strlen(s) >= 24 AND regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '^[A-Za-z0-9._-]*$') THEN -0.12 ELSE 0 END + CASE WHEN contains(s, '.htm') THEN -0.04 ELSE 0 END END"
_SCORED = f"""
WITH {_PARTS}, b AS (SELECT *, len(parts) AS depth,
  (CASE WHEN len(parts) = 0 THEN 0.22 + CASE WHEN contains(url, '#') THEN -0.10 ELSE 0 END ELSE
    CASE len(parts) WHEN 1 THEN 0.16 WHEN 2 THEN 0.08 WHEN 3 THEN -0.04 ELSE -0.20 END + CASE WHEN contains(url, '?') THEN 0 ELSE 0.03 END + CASE WHEN contains(url, '#') THEN -0.10 ELSE 0 END
    + CASE WHEN regexp_matches(parts[-1], '^(class|tag|category)-') THEN -0.10 ELSE 0 END + coalesce(list_sum(list_transform(parts, lambda s: {_SEGMENT})), 0) END)::DOUBLE AS structure,
  CASE WHEN ext = '' OR ext IN ('.html', '.htm', '.xhtml') THEN 'html_like' WHEN ext IN ('.pdf', '.txt', '.md') THEN 'document_file' WHEN ext IN ('.json', '.xml', '.rss', '.atom') THEN 'structured_data'
    WHEN ext IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.svg', '.ico', '.mp4', '.mp3') THEN 'media_asset' WHEN ext IN ('.zip', '.gz', '.tgz') THEN 'archive_file' ELSE 'unknown' END AS resource,
  CASE WHEN len(string_split(host, '.')) - len(string_split(family, '.')) <= 0 THEN 0.20 WHEN len(string_split(host, '.')) - len(string_split(family, '.')) = 1 THEN 0.02 ELSE -0.06 END::DOUBLE AS compact FROM u),
k AS (SELECT *, CASE resource WHEN 'html_like' THEN 0.12 WHEN 'document_file' THEN 0.02 WHEN 'structured_data' THEN -0.28 WHEN 'media_asset' THEN -0.18 WHEN 'archive_file' THEN -0.14 ELSE 0 END::DOUBLE AS kind FROM b),
c AS (SELECT url, host, family, depth, structure, resource, compact, kind, round(0.35::DOUBLE + structure + kind + compact, 6) AS score FROM k)
"""
_ONCE = "(SELECT * FROM (SELECT chunk_no, chunk_id, doc_id, score, text, row_number() OVER (PARTITION BY chunk_no ORDER BY chunk_id DESC, doc_id DESC, score DESC) AS rn FROM chunks) WHERE rn = 1)"
_STOP = "['a','an','and','are','as','at','be','by','for','from','in','into','is','it','of','on','or','that','the','their','this','to','with']"
_RATIO = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0 ELSE {0} END"

SQL = {
    "l01_text_measures": f"""
WITH t AS (SELECT doc_id, text, {_fields('text')} AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, strlen(text)::INTEGER AS bytes, len(text)::INTEGER AS chars, (len(text) - len(translate(text, '.!?;:', '')))::INTEGER AS marks, len(ws)::INTEGER AS words, len({_lines('text')})::INTEGER AS lines, len({_sentences('text')})::INTEGER AS sentences,
  round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: strlen(x))) / len(ws) ELSE 0 END, 6) AS word_bytes,
  round(CASE WHEN len(ws) > 0 THEN len(list_filter(list_transform(ws, lambda x: regexp_replace(x, '^[\\[\\](){{}}<>"''`,]+|[\\[\\](){{}}<>"''`,]+$', '', 'g')), lambda x: len(x) > 1 AND (regexp_matches(x, '^[A-Z]') OR (regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))))) / len(ws) ELSE 0 END, 6) AS title_like,
  len(list_distinct(list_filter(string_split({_alnum('text')}, ' '), lambda x: len(x) >= 3)))::INTEGER AS long_tokens FROM t""",
    "h14_one_line": f"SELECT doc_id, {_one('text')} AS text FROM documents WHERE text IS NOT NULL",
    "h12_junk": "SELECT contains(text, '{') OR contains(text, 'function(') OR (strlen(text) - strlen(replace(text, 'http', ''))) / 4 > 4 AS junk, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "h19_literal_urls": "WITH f AS (SELECT page_no, unnest(regexp_extract_all(html, 'https?://[^\\s\"''<>()]+')) AS url FROM raw_pages WHERE html IS NOT NULL) SELECT DISTINCT page_no, regexp_replace(url, '[.,;:!?]+$', '') AS url FROM f",
    "pack18_shortest": f"""
WITH s AS (SELECT doc_id, text, {_fields(f"coalesce(({_sentences('text')})[1], '')")} AS f FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, list_slice(CASE WHEN len(f) > 8 THEN list_filter(f, lambda w: NOT list_contains({_STOP}, lower(regexp_replace(w, '^[,;:]+|[,;:]+$', '', 'g')))) ELSE f END, 1, 14) AS c FROM s)
SELECT doc_id, array_to_string(CASE WHEN len(c) > 0 THEN c ELSE list_slice({_fields('text')}, 1, 10) END, ' ') AS short FROM k""",
    "pack19_focus_spans": f"""
WITH r AS (SELECT doc_id, {_tokens('title')} AS terms, {_sentences('text')} AS ss FROM documents WHERE text IS NOT NULL AND trim(title) <> ''),
s AS (SELECT doc_id, terms, unnest(ss) AS sentence, unnest(range(len(ss)))::INTEGER AS pos FROM r),
h AS (SELECT doc_id, sentence, pos, len(list_intersect(terms, list_distinct(list_filter(string_split({_alnum('sentence')}, ' '), lambda x: len(x) >= 3))))::INTEGER AS hits FROM s)
SELECT doc_id, hits, pos, sentence FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) = 1""",
    "pack20_formatted": f"WITH t AS (SELECT doc_id, {_head('text', 160)} AS cut FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN cut = '' OR regexp_matches(cut, '[.!?]$') THEN cut ELSE cut || '.' END AS text FROM t",
    "pack27_token_budget": f"WITH t AS (SELECT doc_id, {_fields('text')} AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(ws)::INTEGER AS tokens, array_to_string(list_slice(ws, 1, 48), ' ') AS head FROM t",
    "pack29_summaries": f"""
WITH t AS (SELECT doc_id, {_head('text', 220)} AS head, {_one("coalesce(title, '')")} AS title FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN title <> '' AND head <> '' AND len(head) <= 110 AND NOT contains(lower(head), lower(title)) AND NOT contains(lower(title), lower(head)) THEN title || ': ' || head ELSE head END AS summary FROM t""",
    "pack30_display": rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_one('text')}, '[\p{{Cc}}\p{{Cf}}]', '', 'g'), '\s+([,.:;!?])', '\1', 'g'), ' +', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL",
    "pack32_savings": "SELECT run_id, max(greatest(raw_fetch_chars - final_context_chars, 0)) AS saved, round(max(CASE WHEN raw_fetch_chars > 0 THEN greatest(raw_fetch_chars - final_context_chars, 0) / raw_fetch_chars ELSE 0 END), 6) AS share FROM analytics_runs WHERE run_id IS NOT NULL GROUP BY run_id",
    "v03_findings": """
WITH f AS (SELECT array_to_string(list_filter([CASE WHEN text IS NULL THEN 'no_text' END, CASE WHEN coalesce(trim(title), '') = '' THEN 'no_title' END, CASE WHEN stable_ratio IS NULL THEN 'no_ratio' END,
  CASE WHEN (stable_ratio IS NOT NULL AND NOT isnan(stable_ratio) AND NOT stable_ratio BETWEEN 0 AND 1) OR (novelty_ratio IS NOT NULL AND NOT isnan(novelty_ratio) AND NOT novelty_ratio BETWEEN 0 AND 1) THEN 'ratio_out_of_range' END,
  CASE WHEN n_chars IS NULL THEN 'no_size' END, CASE WHEN n_chars <> len(text) THEN 'wrong_size' END, CASE WHEN updated_at < observed_at THEN 'updated_before_observed' END], lambda x: x IS NOT NULL), ',') AS findings FROM documents)
SELECT findings, count(*) AS documents FROM f GROUP BY findings""",
    "v04_content_ids": "SELECT doc_id, 'doc_' || substr(sha256(coalesce(url, '') || chr(0) || coalesce(text, '')), 1, 16) AS content_id, 'mem_' || substr(sha256(trim(coalesce(url, '')) || '|' || trim(coalesce(title, ''))), 1, 16) AS piped_id FROM documents",
    "l12_url_parts": f"""
WITH p AS (SELECT doc_id, url, {_host('url')} AS host, {_path('url')} AS path FROM documents)
SELECT doc_id, host, path, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INTEGER AS depth, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1 - regexp_matches(host, '\\.(ac|co|com|edu|gob|gouv|gov|govt|go|id|ind|info|ltd|me|mil|ne|net|nhs|nic|nom|or|org|plc|sch)\\.[^.]{{2}}$')::INTEGER, 1), len(string_split(host, '.'))), '.') AS family,
  trim(regexp_replace(lower(host || ' ' || path), '[^a-z0-9]+', ' ', 'g')) AS tokens, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '[?#].*$', ''), '/+$', '') AS canonical FROM p""",
    "l15_ancestors": f"WITH {_PARTS}, a AS (SELECT host, url, parts, unnest(range(1, len(parts) + 1)) AS i FROM u) SELECT host, '/' || array_to_string(list_slice(parts, 1, i), '/') AS root_path, count(DISTINCT url) AS support FROM a GROUP BY 1, 2",
    "d01_candidate_scores": _SCORED + "SELECT url, score, array_to_string(list_filter(['seed_fallback', CASE WHEN structure > 0 THEN 'structure_hint' END, CASE WHEN structure < 0 THEN 'structure_penalty' END, CASE WHEN kind > 0 THEN 'resource_class_hint' END, CASE WHEN kind < 0 THEN 'resource_class_penalty' END, CASE WHEN compact > 0 THEN 'host_compactness' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c",
    "d02_structure": _SCORED + "SELECT url, round(structure, 6) AS structure, resource, round(compact, 6) AS compact FROM c",
    "d08_shallow_preferred": _SCORED + """, o AS (SELECT r.url, sum(CASE WHEN l.host = r.host AND r.depth = 0 THEN 0.28 WHEN r.depth = 0 THEN 0.18 ELSE 0.12 END) AS boost FROM c r JOIN c l ON l.family = r.family AND r.depth < l.depth AND l.score - r.score <= 0.35 GROUP BY r.url)
SELECT c.url, score, round(score + coalesce(boost, 0)::DOUBLE, 4) AS boosted FROM c LEFT JOIN o USING (url)""",
    "o02_candidate_order": _SCORED + "SELECT url, score FROM c ORDER BY score DESC, url LIMIT 100",
    "o06_first_per_family": _SCORED + ", f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, url) = 1) SELECT family, url, score FROM f ORDER BY score DESC, url LIMIT 50",
    "d24_margins": _SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, url) AS rn FROM c), g AS (SELECT family, max(url) FILTER (rn = 1) AS leader, max(score) FILTER (rn = 1) - coalesce(max(score) FILTER (rn = 2), 0) AS m FROM r GROUP BY family) SELECT family, leader, round(m, 6) AS margin, m <= 0.25 AS ambiguous FROM g",
    "j15_evidence_rerank": _SCORED + """, l AS (SELECT url, stable_ratio, novelty_ratio, coalesce(changed_recently, false) AS changed FROM documents QUALIFY row_number() OVER (PARTITION BY url ORDER BY observed_at DESC, doc_id DESC) = 1)
SELECT c.url, round(score + CASE WHEN coalesce(stable_ratio >= 0.80 AND NOT changed AND NOT isnan(stable_ratio), false) THEN -0.20 WHEN coalesce(novelty_ratio > 0.20 AND NOT isnan(novelty_ratio), false) OR changed THEN 0.20 ELSE 0 END, 6) AS reranked FROM c LEFT JOIN l USING (url)""",
    "a14_host_seeds": _SCORED + ", h AS (SELECT family, host, sum(score) AS total, max((score, url)) AS best, arg_max(url, (score, url)) AS url, max(score) AS top FROM c GROUP BY family, host), v AS (SELECT family, url, round(top + total * 0.35, 4) AS value FROM h) SELECT family, url, value FROM v QUALIFY row_number() OVER (PARTITION BY family ORDER BY value DESC, url DESC) = 1",
    "a17_merged_candidates": _SCORED + f""", d AS (SELECT d.url, round(c.score + {_RATIO.format('novelty_ratio')}, 6) AS score, title, source_kind FROM documents d JOIN c USING (url))
SELECT url, max(score) AS score, arg_max(title, (score, title)) FILTER (trim(title) <> '') AS label, coalesce(string_agg(DISTINCT source_kind, ',' ORDER BY source_kind), '') AS reasons, count(*) AS sources FROM d GROUP BY url""",
    "a06_memory_stats": "SELECT 'documents' AS name, count(*) AS n, max(observed_at) AS last FROM documents UNION ALL SELECT 'topic_nodes', count(*), max(observed_at) FROM topic_nodes UNION ALL SELECT 'topic_docs', count(*), max(observed_at) FROM topic_docs",
    "a11_seen_counts": "SELECT url, count(*) AS seen, min(observed_at) AS first_seen, max(observed_at) AS last_seen, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM documents WHERE trim(url) <> '' GROUP BY url",
    "a12_host_profiles": "SELECT lower(host) AS host, count(*) AS seen, max(n_chars) AS most_chars, arg_max(lang, (observed_at, doc_id)) FILTER (trim(lang) <> '') AS lang, arg_max(title, (observed_at, doc_id)) FILTER (trim(title) <> '') AS title, bool_or(coalesce(changed_recently, false)) AS ever_changed FROM documents WHERE trim(host) <> '' GROUP BY 1",
    "k01_upserted_documents": "SELECT url, doc_id, source, observed_at FROM documents QUALIFY row_number() OVER (PARTITION BY url ORDER BY observed_at DESC, doc_id DESC) = 1",
    "k04_export_order": "SELECT url, observed_at, doc_id FROM documents ORDER BY observed_at DESC, url, doc_id",
    "k07_pruned_documents": "SELECT source_kind, count(*) AS kept FROM documents WHERE observed_at IS NULL OR observed_at >= TIMESTAMP '2025-03-20' GROUP BY source_kind",
    "k08_retained_documents": "SELECT doc_id, url FROM documents ORDER BY observed_at DESC, url, doc_id LIMIT 300",
    "o05_latest_per_host": "WITH d AS (SELECT url, max((observed_at, lower(host), path)) AS m, arg_max(lower(host), (observed_at, lower(host), path)) AS host, arg_max(path, (observed_at, lower(host), path)) AS path, max(observed_at) AS observed_at FROM documents GROUP BY url) SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY observed_at DESC, len(path), url)::INTEGER AS rank FROM d WHERE host IS NOT NULL QUALIFY rank <= 3",
    "u01_union_max": "SELECT url, max(seen_at) AS seen_at, count(*) AS n FROM (SELECT url, observed_at AS seen_at FROM documents UNION ALL SELECT url, fetched_at FROM raw_pages) WHERE url IS NOT NULL GROUP BY url",
    "u02_distinct_hints": f"""
WITH h AS (SELECT doc_id, list_filter(list_transform(list_concat(coalesce(from_json(entity_hints_json, '["VARCHAR"]'), []), coalesce(from_json(category_hints_json, '["VARCHAR"]'), []), coalesce(from_json(locality_hints_json, '["VARCHAR"]'), [])), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, to_json({_first_distinct('l')})::VARCHAR AS hints FROM h""",
    "u03_fetched_only": "SELECT url, 'both' AS found FROM (SELECT url FROM documents INTERSECT SELECT url FROM raw_pages) UNION ALL SELECT url, 'document_only' FROM (SELECT url FROM documents EXCEPT SELECT url FROM raw_pages)",
    "j10_fetched_documents": "SELECT doc_id FROM documents WHERE url IN (SELECT url FROM raw_pages)",
    "j11_unfetched_documents": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM raw_pages p WHERE p.url = d.url)",
    "j07_agent_context": f"SELECT c.chunk_no, c.chunk_id, d.url, coalesce(nullif(trim(d.title), ''), nullif(trim(d.url), '')) AS label, from_json(d.proof_refs_json, '[\"VARCHAR\"]')[1] AS proof_id, round(c.score, 6) AS score FROM {_ONCE} c LEFT JOIN documents d USING (doc_id)",
    "j08_fingerprint_delta": """
WITH l AS (SELECT DISTINCT snapshot_no, document_id, lower(trim(fingerprint)) AS fp FROM fingerprint_records), n AS (SELECT max(snapshot_no) AS most, min(snapshot_no) AS least FROM l),
a AS (SELECT snapshot_no + 1 AS snapshot_no, document_id, fp, 1 AS x FROM l WHERE snapshot_no < (SELECT most FROM n)), b AS (SELECT *, 1 AS y FROM l WHERE snapshot_no > (SELECT least FROM n))
SELECT snapshot_no, document_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'retained' END AS status, count(*) AS n FROM a FULL JOIN b USING (snapshot_no, document_id, fp) GROUP BY 1, 2, 3""",
    "j09_title_changes": """
WITH l AS (SELECT snapshot_no, lower(trim(url)) AS url, title FROM document_snapshots QUALIFY row_number() OVER (PARTITION BY snapshot_no, lower(trim(url)) ORDER BY updated_at DESC NULLS LAST, delivered_at DESC NULLS LAST, title DESC NULLS LAST) = 1), n AS (SELECT max(snapshot_no) AS most, min(snapshot_no) AS least FROM l),
f AS (SELECT snapshot_no, url, a.title AS old_value, b.title AS new_value, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN a.title IS DISTINCT FROM b.title THEN 'changed' END AS status
  FROM (SELECT snapshot_no + 1 AS snapshot_no, url, title, 1 AS x FROM l WHERE snapshot_no < (SELECT most FROM n)) a FULL JOIN (SELECT *, 1 AS y FROM l WHERE snapshot_no > (SELECT least FROM n)) b USING (snapshot_no, url))
SELECT * FROM f WHERE status IS NOT NULL""",
    "j06_scored_join": _SCORED + ", o AS (SELECT doc_id, avg(score) AS s FROM (SELECT chunk_no, doc_id, score FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_no ORDER BY doc_id DESC, score DESC) = 1) GROUP BY doc_id) SELECT d.doc_id, round(0.35::DOUBLE + structure + kind + compact + 3 * coalesce(s, 0), 6) AS score FROM documents d JOIN c USING (url) LEFT JOIN o ON o.doc_id = d.doc_id",
    "e01_fidelity": """
WITH t AS (SELECT doc_id, coalesce(from_json(entity_hints_json, '["VARCHAR"]'), []) AS terms, coalesce(text, '') AS text FROM documents), h AS (SELECT doc_id, len(terms) AS n, len(list_filter(terms, lambda t: contains(text, t))) AS k FROM t)
SELECT doc_id, n::INTEGER AS expected, k::INTEGER AS found, round(CASE WHEN n = 0 THEN 1 ELSE k / n END, 6) AS fidelity FROM h""",
    "e02_compression": f"""
WITH r AS (SELECT page_no, max(len({_fields('html')})) AS raw FROM raw_pages WHERE html IS NOT NULL GROUP BY page_no), o AS (SELECT page_no, pos, max(text) AS text FROM simplified_nodes GROUP BY page_no, pos), k AS (SELECT page_no, sum(len({_fields('text')}))::BIGINT AS kept FROM o GROUP BY page_no)
SELECT page_no, raw::INTEGER AS raw, kept, round(CASE WHEN kept > 0 THEN raw / kept ELSE 0 END, 6) AS ratio FROM r JOIN k USING (page_no)""",
    "e03_density": f"WITH t AS (SELECT doc_id, {_fields('lower(text)')} AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END, 6) AS density FROM t",
    "e04_fact_coverage": f"""
WITH t AS (SELECT doc_id, ' ' || {_alnum('text')} || ' ' AS plain, {_tokens('title')} AS terms FROM documents WHERE text IS NOT NULL AND trim(title) <> '')
SELECT doc_id, array_to_string(list_filter(terms, lambda t: contains(plain, ' ' || t || ' ')), ' ') AS covered, array_to_string(list_filter(terms, lambda t: NOT contains(plain, ' ' || t || ' ')), ' ') AS missing FROM t""",
    "e09_noise_hits": "SELECT chunk_no, len(list_filter(['cookie', 'newsletter', 'privacy', 'all rights reserved', 'follow'], lambda t: contains(lower(text), t)))::INTEGER AS hits FROM (SELECT chunk_no, max(text) AS text FROM chunks GROUP BY chunk_no) WHERE text IS NOT NULL",
    "pack13_exact_repeats": f"WITH n AS (SELECT doc_id, {_one('lower(text)')} AS norm FROM documents WHERE text IS NOT NULL) SELECT sha256(norm) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM n WHERE norm <> '' GROUP BY norm",
    "o10_promoted": _SCORED + ", n AS (SELECT lower(host) AS host, url AS chosen FROM documents QUALIFY row_number() OVER (PARTITION BY lower(host) ORDER BY observed_at DESC, doc_id DESC) = 1), t AS (SELECT host, max(score) AS top FROM c GROUP BY host) SELECT url, round(CASE WHEN url = chosen THEN greatest(score + 0.6, top + 0.12) ELSE score END, 6) AS score FROM c LEFT JOIN n USING (host) JOIN t USING (host)",
}

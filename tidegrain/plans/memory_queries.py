"""Queries over vectors, topics and graphs, evaluation, and streamed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.functions import urls
from tidegrain.functions.values import findings
from tidegrain.operators import analytics, graphs, keyed, retrieval
from tidegrain.operators.pages import page_links
from tidegrain.runtime import stage
from tidegrain.sources.tables import table
from tidegrain.streaming import folds

#: The time that recency is measured at.
AS_OF = "2025-05-01 00:00:00"


def _now():  # noqa: ANN202
    return F.lit(AS_OF).cast("timestamp_ntz")


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "topic_docs").select("vec_id", "vector").unionByName(table(spark, root, "topic_nodes").select("vec_id", "vector"))


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))


def _proved():  # noqa: ANN202
    return F.coalesce(F.size(F.from_json("proof_refs_json", "array<string>")) > 0, F.lit(False))


def _remembered(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each address, host in lower case."""
    rows = table(spark, root, "documents").select("url", F.lower("host").alias("host"), "path", "observed_at", "stable_ratio", "novelty_ratio", "changed_recently", _proved().alias("proved"), "doc_id")
    return keyed.newest(rows, ["url"], ["observed_at", "doc_id"]).drop("doc_id")


def j05_similar_vectors(spark: SparkSession, root: str) -> DataFrame:
    rows = _vectors(spark, root)
    found = retrieval.most_similar(_asked(rows), rows, 5)
    return found.select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


def _document_hits(spark: SparkSession, root: str, k: int) -> DataFrame:
    """The k remembered documents of each query that score best."""
    stored = table(spark, root, "topic_docs")
    bonus = retrieval.document_score(F.lit(0.0), _now(), proved=F.col("proved"))
    known = stage(stored.select("vec_id", "url", "vector").distinct().join(_remembered(spark, root), "url").select("vec_id", "url", "vector", bonus.alias("bonus")))
    hits = retrieval.best_scored(_asked(stored), known, k, 3.0, positive=True).drop("score").join(known.drop("vector"), "vec_id")
    return hits.withColumn("score", F.round(F.col("similarity") * 3 + F.col("bonus"), 6))


def d16_document_hits(spark: SparkSession, root: str) -> DataFrame:
    return _document_hits(spark, root, 5).select("query_id", "url", "score")


def _topic_hits(spark: SparkSession, root: str, k: int) -> DataFrame:
    """The k topic nodes of each query that score best."""
    nodes = table(spark, root, "topic_nodes")
    known = nodes.withColumn("bonus", retrieval.topic_score(F.lit(0.0), _now()))
    hits = retrieval.best_scored(_asked(table(spark, root, "topic_docs")), known, k, 3.15, positive=True).drop("score").join(nodes.drop("vector"), "vec_id")
    return hits.withColumn("score", F.round(retrieval.topic_score(F.col("similarity"), _now()), 6))


def d16_topic_hits(spark: SparkSession, root: str) -> DataFrame:
    return _topic_hits(spark, root, 5).select("query_id", "topic_key", F.col("representative_url").alias("url"), "score")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each address once."""
    best = found.groupBy("query_id", "url").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "url"))).where(F.col("rank") <= k).drop("rank")


def d15_memory_search(spark: SparkSession, root: str) -> DataFrame:
    """Documents and topics that meet a query, the roots above them, the pages
    they link to and the latest pages of their hosts (three of each kind),
    merged by address: the best five of a score of .15 or more."""
    known = stage(_remembered(spark, root))
    add = lambda have, more: stage(have.unionByName(more.select("query_id", "url", "score")).groupBy("query_id", "url").agg(F.max("score").alias("score")))
    found = add(d16_document_hits(spark, root), d16_topic_hits(spark, root))
    placed = found.select("query_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    found = add(found, retrieval.ancestor_roots(placed, known, _now(), 3, inclusive=True, proved=F.col("proved")))
    edges = _page_edges(spark, root).join(known.select(F.col("url").alias("target")), "target", "left_semi")
    linked = retrieval.neighbours(found.select("query_id", "url"), edges, 3).select("query_id", F.col("target").alias("url"), "score")
    found = add(found, _first(linked, 3))
    hosts = found.select("query_id", urls.host(F.col("url")).alias("host")).distinct()
    latest = retrieval.host_pages(known, 3).withColumn("score", retrieval.host_score(_now(), F.col("proved")))
    found = add(found, _first(hosts.join(latest, "host"), 3))
    return _first(found.select("query_id", "url", F.round("score", 6).alias("score")).where("score >= 0.15"), 5)


def j04_ancestor_roots(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")).distinct()
    found = retrieval.ancestor_roots(asked, _remembered(spark, root), _now(), 5)
    return found.select("query_id", "url", "support", F.round("score", 6).alias("score"), "rank")


def _page_edges(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "raw_pages")
    times = pages.groupBy("page_no").agg(F.max("fetched_at").alias("observed_at"))
    edges = page_links(pages).join(times, "page_no").select("url", "target", (urls.host(F.col("url")) == urls.host(F.col("target"))).alias("same_host"), "observed_at")
    return edges.groupBy("url", "target").agg(F.max("same_host").alias("same_host"), F.max("observed_at").alias("observed_at"))


def j02_neighbours(spark: SparkSession, root: str) -> DataFrame:
    hits = table(spark, root, "raw_pages").select(F.col("url").alias("query_id"), "url").distinct()
    return retrieval.neighbours(hits, _page_edges(spark, root), 3).select("url", "target", "rank", F.round("score", 6).alias("score"))


def j03_prefix_support(spark: SparkSession, root: str) -> DataFrame:
    """Documents at or below the root path of each topic node."""
    nodes = table(spark, root, "topic_nodes").select(F.lower("host").alias("host"), "root_path").distinct()
    below = retrieval.with_ancestors(_remembered(spark, root).select("url", "host", "path"))
    counted = nodes.join(below, ["host", "root_path"], "left").groupBy("host", "root_path").agg(F.count("url").alias("support"))
    return counted


def _topic_documents(spark: SparkSession, root: str) -> DataFrame:
    rows = keyed.newest(retrieval.fit_vectors(table(spark, root, "topic_docs")), ["url"], ["observed_at", "vec_id"])
    return rows.select(urls.host(F.col("url")).alias("host"), "path", "url", "title", "summary", "observed_at", "vector", "vec_id")


def d18_topics(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.topics(_topic_documents(spark, root)).drop("vector")


def a08_topic_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The components of each topic's mean vector."""
    rows = retrieval.topics(_topic_documents(spark, root)).select("topic_key", F.posexplode("vector").alias("i", "x"))
    return rows.select("topic_key", "i", F.round("x", 4).alias("x"))


def a09_topic_summaries(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.topic_summaries(_topic_documents(spark, root))


def _host_steps(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "analytics_runs").select("goal_hash", "completed_at", "run_id", F.lower(F.trim("host")).alias("host")).distinct()
    return graphs.transitions(runs, "goal_hash", ["completed_at", "run_id"], "host")


def t05_host_transitions(spark: SparkSession, root: str) -> DataFrame:
    return _host_steps(spark, root)


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    top = table(spark, root, "analytics_runs").where("trim(host) != ''").groupBy(F.lower(F.trim("host")).alias("place")).agg(F.count("*").alias("n"))
    return top.orderBy(F.desc("n"), "place").limit(2).select("place")


def j13_expanded_hosts(spark: SparkSession, root: str) -> DataFrame:
    found = graphs.expanded(_host_steps(spark, root), _seeds(spark, root), 20)
    return found.select("place", "score", F.array_join("reasons", ",").alias("reasons"))


def d19_reached_hosts(spark: SparkSession, root: str) -> DataFrame:
    return graphs.reached(_host_steps(spark, root), _seeds(spark, root), 3)


def a16_components(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hang together by address or title."""
    rows = table(spark, root, "documents").select(F.concat(F.lit("d"), "doc_id").alias("a"), "url", "title")
    edges = rows.select("a", F.concat(F.lit("u"), "url").alias("b")).unionAll(rows.where("trim(title) != ''").select("a", F.concat(F.lit("t"), "title")))
    return graphs.components(edges).where("node LIKE 'd%'").select("node", "component")


def a15_component_sizes(spark: SparkSession, root: str) -> DataFrame:
    sizes = a16_components(spark, root).groupBy("component").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("components"))


def e05_same_address(spark: SparkSession, root: str) -> DataFrame:
    """Whether the final address of a document is the one asked for."""
    rows = table(spark, root, "documents")
    return rows.groupBy((urls.canonical(F.col("url")) == urls.canonical(F.col("final_url"))).alias("same")).agg(F.count("*").alias("documents"))


def e06_burden(spark: SparkSession, root: str) -> DataFrame:
    """Steps from a claim to its source and work left to do, per operation."""
    runs = table(spark, root, "analytics_runs")
    hops = F.lit(1) + F.when(~F.col("proof_usable"), 1).otherwise(0)
    burden = F.when(F.col("packet_bytes") > 20_000, 2).when(F.col("packet_bytes") > 8_000, 1).otherwise(0) + F.when(F.coalesce("chunk_count", F.lit(0)) == 0, 1).otherwise(0)
    return runs.groupBy("operation").agg(F.sum(hops).cast("bigint").alias("hops"), F.sum(burden).cast("bigint").alias("burden"), F.count("*").alias("runs"))


def e07_failure_labels(spark: SparkSession, root: str) -> DataFrame:
    """All that is the matter with runs, by combination."""
    labels = findings(
        (~F.col("success"), "runtime"), (F.col("latency_ms") >= 5000, "slow"), (~F.col("proof_usable"), "proof"), (F.coalesce("chunk_count", F.lit(0)) == 0, "empty"), (F.coalesce("latency_ms", F.lit(-1)) < 0, "no_latency"),
    )
    return table(spark, root, "analytics_runs").groupBy(F.array_join(labels, ",").alias("labels")).agg(F.count("*").alias("runs"))


def e08_lossiness(spark: SparkSession, root: str) -> DataFrame:
    """Risk that a packet lost what was asked for, by level and operation."""
    runs = table(spark, root, "analytics_runs").where("raw_fetch_chars > 0 AND final_context_chars >= 0")
    drop = F.greatest(F.lit(0.0), 1 - F.col("final_context_chars") / F.col("raw_fetch_chars"))
    risk = F.round(drop * 0.3 + F.when(F.col("proof_usable"), 0.0).otherwise(0.7), 6)
    return runs.groupBy("operation", F.when(risk >= 0.45, "high").when(risk >= 0.20, "medium").otherwise("low").alias("level")).agg(F.count("*").alias("runs"))


def t01_appended_stream(spark: SparkSession, root: str) -> DataFrame:
    return folds.drained(folds.appended_runs(folds.stream_table(spark, root, "analytics_runs")), "append")


def t02_upserted_stream(spark: SparkSession, root: str) -> DataFrame:
    columns = ["url", "doc_id", "source", "observed_at"]
    return folds.upserted_stream(folds.stream_table(spark, root, "documents"), ["url"], ["observed_at", "doc_id"], columns)


def t03_host_stream(spark: SparkSession, root: str) -> DataFrame:
    return folds.drained(folds.host_profiles(folds.stream_table(spark, root, "documents")), "complete")


def t06_provider_stream(spark: SparkSession, root: str) -> DataFrame:
    """The last state of each provider; all files come in one batch here."""
    seen = folds.drained(folds.provider_health(analytics.outcomes(folds.stream_table(spark, root, "analytics_runs"))), "update")
    return keyed.newest(seen.withColumn("n", F.expr("success + timeout + failure")), ["provider"], ["n"]).drop("n")


def t08_delta_stream(spark: SparkSession, root: str) -> DataFrame:
    return folds.drained(folds.snapshot_deltas(folds.stream_table(spark, root, "fingerprint_records")), "append")


def t10_daily_stream(spark: SparkSession, root: str) -> DataFrame:
    return folds.drained(folds.daily_rollup(folds.stream_table(spark, root, "analytics_runs")), "complete")


def x_sliding_stream(spark: SparkSession, root: str) -> DataFrame:
    return folds.drained(folds.tumbling_counts(folds.stream_table(spark, root, "events"), "2 hours", "1 hour"), "complete")


def x_tumbling_stream(spark: SparkSession, root: str) -> DataFrame:
    return folds.drained(folds.tumbling_counts(folds.stream_table(spark, root, "events"), "1 hour"), "complete")


def x_session_stream(spark: SparkSession, root: str) -> DataFrame:
    return folds.drained(folds.sessions(folds.stream_table(spark, root, "events"), "6 hours"), "complete")


QUERIES = {
    f.__name__: f
    for f in (
        a08_topic_vectors, a09_topic_summaries, a15_component_sizes, a16_components, d15_memory_search, d16_document_hits, d16_topic_hits, d18_topics, d19_reached_hosts, e05_same_address, e06_burden, e07_failure_labels, e08_lossiness,
        j02_neighbours, j03_prefix_support, j04_ancestor_roots, j05_similar_vectors, j13_expanded_hosts, t01_appended_stream, t02_upserted_stream, t03_host_stream, t05_host_transitions, t06_provider_stream, t08_delta_stream, t10_daily_stream,
        x_session_stream, x_sliding_stream, x_tumbling_stream,
    )
}

_FIT = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_COS = "round(list_cosine_similarity(q.vector::DOUBLE[], r.vector::DOUBLE[]), 9)"
_RECENCY = f"CASE WHEN observed_at IS NULL THEN 0 WHEN date_diff('second', observed_at, TIMESTAMP '{AS_OF}') <= 86400 THEN 0.12 WHEN date_diff('second', observed_at, TIMESTAMP '{AS_OF}') <= 7 * 86400 THEN 0.08 WHEN date_diff('second', observed_at, TIMESTAMP '{AS_OF}') <= 30 * 86400 THEN 0.04 ELSE 0 END"
_RATIO = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0 ELSE {0} END"
_KNOWN = "known AS (SELECT url, lower(host) AS host, path, observed_at, stable_ratio, novelty_ratio, changed_recently, coalesce(CASE WHEN json_valid(proof_refs_json) THEN json_array_length(proof_refs_json) END, 0) > 0 AS proved FROM documents QUALIFY row_number() OVER (PARTITION BY url ORDER BY observed_at DESC NULLS LAST, doc_id DESC) = 1)"
_NEAR = f"""near AS (SELECT q.vec_id AS query_id, r.vec_id, {_COS} AS similarity FROM (SELECT DISTINCT vec_id, vector FROM {{0}} WHERE vec_id % 20 = 0 AND {_FIT}) q, (SELECT * FROM {{1}} WHERE {_FIT}) r
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, r.vec_id) <= 5)"""
_BOTH = "(SELECT vec_id, vector FROM topic_docs UNION ALL SELECT vec_id, vector FROM topic_nodes)"
_ASKED = f"asked AS (SELECT DISTINCT vec_id AS query_id, vector FROM topic_docs WHERE vec_id % 20 = 0 AND {_FIT})"
_DOCHITS = f"""{_KNOWN}, {_ASKED}, stored AS (SELECT DISTINCT vec_id, t.url, vector, {_RECENCY.replace('observed_at', 'k.observed_at')} + CASE WHEN stable_ratio > 0 AND NOT isnan(stable_ratio) THEN stable_ratio ELSE 0 END * 0.08 + {_RATIO.format('novelty_ratio')} * 0.08 + CASE WHEN changed_recently THEN 0.06 ELSE 0 END + CASE WHEN proved THEN 0.08 ELSE 0 END AS bonus FROM topic_docs t JOIN known k ON k.url = t.url WHERE {_FIT}),
docall AS (SELECT query_id, vec_id, url, {_COS} AS similarity, bonus FROM asked q, stored r),
dochits AS (SELECT query_id, url, round(3 * similarity + bonus, 6) AS score FROM docall WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(3 * similarity + bonus, 9) DESC, vec_id) <= 5)"""
_TOPBONUS = f"0.18 * least(greatest(support_count - 1, 0), 4) + 0.12 * least(child_count, 3) + CASE WHEN topic_depth > 0 THEN 0.42::DOUBLE / (topic_depth + 1) ELSE 0 END + {_RECENCY}"
_TOPHITS = f"""topall AS (SELECT query_id, vec_id, topic_key, representative_url AS url, {_COS} AS similarity, {_TOPBONUS} AS bonus FROM asked q, (SELECT * FROM topic_nodes WHERE {_FIT}) r),
tophits AS (SELECT query_id, topic_key, url, round(3.15 * similarity + bonus, 6) AS score FROM topall WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(3.15 * similarity + bonus, 9) DESC, vec_id) <= 5)"""
_HOSTOF = "lower(nullif(regexp_extract(url, '(?i)^\\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), ''))"
_PARTS = "list_filter(string_split({0}, '/'), lambda x: x <> '')"
_TOPICS = f"""
WITH t AS (SELECT {_HOSTOF} AS host, path, url, title, summary, observed_at, vector FROM topic_docs WHERE {_FIT} QUALIFY row_number() OVER (PARTITION BY url ORDER BY observed_at DESC NULLS LAST, vec_id DESC) = 1),
x AS (SELECT *, {_PARTS.format('path')} AS parts FROM t), y AS (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM x),
z AS (SELECT *, '/' || array_to_string(list_slice(parts, 1, i), '/') AS root_path FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY host, root_path ORDER BY len(path), observed_at DESC, url) AS rn FROM z)
"""
_STEPS = """steps AS (SELECT host AS from_place, lead(host) OVER (PARTITION BY goal_hash ORDER BY completed_at NULLS FIRST, run_id) AS to_place, completed_at AS at_time
  FROM (SELECT DISTINCT goal_hash, completed_at, run_id, lower(trim(host)) AS host FROM analytics_runs WHERE goal_hash IS NOT NULL AND trim(host) <> '')),
edges AS (SELECT from_place, to_place, count(*) AS count, max(at_time) AS last_seen FROM steps WHERE to_place IS NOT NULL AND from_place <> to_place GROUP BY 1, 2),
seeds AS (SELECT lower(trim(host)) AS place, count(*) AS n FROM analytics_runs WHERE trim(host) <> '' GROUP BY 1 ORDER BY n DESC, place LIMIT 2)"""
_COMPONENTS = """
WITH RECURSIVE e AS (SELECT 'd' || doc_id AS a, 'u' || url AS b FROM documents UNION ALL SELECT 'd' || doc_id, 't' || title FROM documents WHERE trim(title) <> ''),
b AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT DISTINCT a AS node, a AS label FROM b UNION SELECT b.b, r.label FROM r JOIN b ON b.a = r.node WHERE r.label < b.b),
c AS (SELECT node, min(label) AS component FROM r GROUP BY node)
"""

SQL = {
    "j05_similar_vectors": f"WITH {_NEAR.format(_BOTH, _BOTH)} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INTEGER AS rank, round(similarity, 6) AS similarity FROM near",
    "d16_document_hits": f"WITH {_DOCHITS} SELECT * FROM dochits",
    "d16_topic_hits": f"WITH {_ASKED}, {_TOPHITS} SELECT * FROM tophits",
    "d15_memory_search": f"""
WITH {_DOCHITS}, {_TOPHITS}, f1 AS (SELECT query_id, url, max(score) AS score FROM (SELECT * FROM dochits UNION ALL SELECT query_id, url, score FROM tophits) GROUP BY 1, 2),
w AS (SELECT DISTINCT query_id, host, '/' || array_to_string(list_slice(parts, 1, i), '/') AS root_path FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT query_id, {_HOSTOF} AS host, {_PARTS.format("regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)")} AS parts FROM f1))),
pp AS (SELECT host, url, {_PARTS.format('path')} AS parts FROM known), s AS (SELECT host, '/' || array_to_string(list_slice(parts, 1, i), '/') AS root_path, count(DISTINCT url) AS support FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pp) GROUP BY 1, 2),
roots AS (SELECT query_id, k.url, 1.4::DOUBLE + least((support - 1) * 0.32, 0.9) + {_RECENCY} + {_RATIO.format('stable_ratio')} * 0.05 + {_RATIO.format('novelty_ratio')} * 0.05 + CASE WHEN proved THEN 0.06 ELSE 0 END AS score FROM w JOIN s USING (host, root_path) JOIN known k ON k.host = w.host AND k.path = w.root_path WHERE support >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, k.url) <= 3),
f2 AS (SELECT query_id, url, max(score) AS score FROM (SELECT * FROM f1 UNION ALL SELECT * FROM roots) GROUP BY 1, 2),
p AS (SELECT DISTINCT page_no, url, html FROM raw_pages WHERE html IS NOT NULL), t AS (SELECT page_no, max(fetched_at) AS observed_at FROM raw_pages GROUP BY page_no),
l AS (SELECT page_no, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href FROM p),
e AS (SELECT url, regexp_extract(url, '^https?://[^/]+') || href AS target, max(observed_at) AS observed_at FROM l JOIN t USING (page_no) GROUP BY 1, 2),
near AS (SELECT query_id, target FROM f2 JOIN (SELECT e.* FROM e JOIN known k ON k.url = e.target) x ON x.url = f2.url QUALIFY row_number() OVER (PARTITION BY query_id, f2.url ORDER BY observed_at DESC, target) <= 3),
linked AS (SELECT DISTINCT query_id, target AS url, 0.9::DOUBLE AS score FROM near QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY target) <= 3),
f3 AS (SELECT query_id, url, max(score) AS score FROM (SELECT * FROM f2 UNION ALL SELECT * FROM linked) GROUP BY 1, 2),
hosts AS (SELECT DISTINCT query_id, {_HOSTOF} AS host FROM f3),
latest AS (SELECT host, url, 0.78::DOUBLE + {_RECENCY} + greatest({_RATIO.format('stable_ratio')}, 0) * 0.05 + greatest({_RATIO.format('novelty_ratio')}, 0) * 0.05 + CASE WHEN proved THEN 0.06 ELSE 0 END AS score FROM known WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY observed_at DESC NULLS LAST, length(path), url) <= 3),
hosted AS (SELECT query_id, url, score FROM hosts JOIN latest USING (host) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) <= 3),
f4 AS (SELECT query_id, url, round(max(score), 6) AS score FROM (SELECT * FROM f3 UNION ALL SELECT * FROM hosted) GROUP BY 1, 2)
SELECT * FROM f4 WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) <= 5""",
    "j04_ancestor_roots": f"""
WITH {_KNOWN}, a AS (SELECT DISTINCT doc_id AS query_id, {_HOSTOF} AS host, {_PARTS.format("regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)")} AS parts FROM documents WHERE doc_id % 20 = 0),
w AS (SELECT DISTINCT query_id, host, '/' || array_to_string(list_slice(parts, 1, i), '/') AS root_path FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM a)),
p AS (SELECT host, url, {_PARTS.format('path')} AS parts FROM known), s AS (SELECT host, '/' || array_to_string(list_slice(parts, 1, i), '/') AS root_path, count(DISTINCT url) AS support FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p) GROUP BY 1, 2),
h AS (SELECT query_id, k.url, support, round(1.4::DOUBLE + least((support - 1) * 0.32, 0.9) + {_RECENCY} + {_RATIO.format('stable_ratio')} * 0.05 + {_RATIO.format('novelty_ratio')} * 0.05, 6) AS score FROM w JOIN s USING (host, root_path) JOIN known k ON k.host = w.host AND k.path = w.root_path WHERE support >= 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url)::INTEGER AS rank FROM h QUALIFY rank <= 5""",
    "j02_neighbours": r"""
WITH p AS (SELECT DISTINCT page_no, url, html FROM raw_pages WHERE html IS NOT NULL), t AS (SELECT page_no, max(fetched_at) AS observed_at FROM raw_pages GROUP BY page_no),
l AS (SELECT page_no, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href FROM p),
e AS (SELECT url, regexp_extract(url, '^https?://[^/]+') || href AS target, max(observed_at) AS observed_at FROM l JOIN t USING (page_no) GROUP BY 1, 2),
r AS (SELECT url, target, row_number() OVER (PARTITION BY url ORDER BY observed_at DESC, target)::INTEGER AS rank FROM e)
SELECT url, target, rank, 0.9::DOUBLE AS score FROM r WHERE rank <= 3""",
    "j03_prefix_support": f"WITH {_KNOWN}, n AS (SELECT DISTINCT lower(host) AS host, root_path FROM topic_nodes) SELECT n.host, root_path, count(k.url) AS support FROM n LEFT JOIN known k ON k.host = n.host AND (k.path = root_path OR starts_with(k.path, root_path || '/')) GROUP BY 1, 2",
    "d18_topics": _TOPICS + "SELECT lower(trim(host)) || '|' || root_path AS topic_key, host, root_path, max(url) FILTER (rn = 1) AS representative_url, max(title) FILTER (rn = 1) AS representative_title, count(*) AS support_count, count(*) - 1 AS child_count, len(list_filter(string_split(root_path, '/'), lambda x: x <> ''))::INTEGER AS topic_depth, max(observed_at) AS observed_at FROM r GROUP BY host, root_path",
    "a08_topic_vectors": _TOPICS + """, d AS (SELECT host, root_path, len(parts) AS depth FROM r WHERE rn = 1),
w AS (SELECT r.host, r.root_path, CASE WHEN rn = 1 THEN 1.75 ELSE 1 END + CASE WHEN len(parts) = depth THEN 0.25 ELSE 0 END AS w, vector FROM r JOIN d USING (host, root_path)),
u AS (SELECT host, root_path, w::DOUBLE AS w, unnest(vector)::DOUBLE AS x, unnest(range(64))::INTEGER AS i FROM w)
SELECT lower(trim(host)) || '|' || root_path AS topic_key, i, round(sum(x * w) / sum(w), 4) AS x FROM u GROUP BY host, root_path, i""",
    "a09_topic_summaries": _TOPICS + r""", p AS (SELECT host, root_path, list_filter(flatten(list([coalesce(nullif(trim(title), ''), nullif(trim(summary), '')), trim(summary)] ORDER BY rn)), lambda x: coalesce(x, '') <> '') AS l FROM r WHERE rn <= 4 GROUP BY 1, 2),
j AS (SELECT host, root_path, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ' ') AS s FROM p)
SELECT host, root_path, coalesce(nullif(trim(substr(trim(regexp_replace(s, '[\s\x{0b}\x{85}\pZ]+', ' ', 'g')), 1, 800)), ''), nullif(trim(root_path), '')) AS summary FROM j""",
    "t05_host_transitions": f"WITH {_STEPS} SELECT from_place, to_place, count, last_seen FROM edges",
    "j13_expanded_hosts": f"""
WITH {_STEPS}, m AS (SELECT to_place AS place, count::DOUBLE AS score, 'outbound_transition' AS reason FROM edges WHERE from_place IN (SELECT place FROM seeds) UNION ALL SELECT from_place, count * 0.5::DOUBLE, 'inbound_transition' FROM edges WHERE to_place IN (SELECT place FROM seeds))
SELECT place, sum(score) AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM m WHERE place NOT IN (SELECT place FROM seeds) GROUP BY place ORDER BY 2 DESC, 1 LIMIT 20""",
    "d19_reached_hosts": f"WITH RECURSIVE {_STEPS}, r AS (SELECT place, 0 AS depth FROM seeds UNION SELECT to_place, depth + 1 FROM r JOIN edges ON from_place = place WHERE depth < 3) SELECT place, min(depth)::INTEGER AS depth FROM r GROUP BY place",
    "a16_components": _COMPONENTS + "SELECT node, component FROM c WHERE node LIKE 'd%'",
    "a15_component_sizes": _COMPONENTS + ", s AS (SELECT component, count(*) AS members FROM c WHERE node LIKE 'd%' GROUP BY component) SELECT members, count(*) AS components FROM s GROUP BY members",
    "e05_same_address": "WITH c AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '[?#].*$', ''), '/+$', '') AS a, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(final_url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '[?#].*$', ''), '/+$', '') AS b FROM documents) SELECT a = b AS same, count(*) AS documents FROM c GROUP BY 1",
    "e06_burden": "SELECT operation, sum(1 + CASE WHEN NOT proof_usable THEN 1 ELSE 0 END)::BIGINT AS hops, sum(CASE WHEN packet_bytes > 20000 THEN 2 WHEN packet_bytes > 8000 THEN 1 ELSE 0 END + CASE WHEN coalesce(chunk_count, 0) = 0 THEN 1 ELSE 0 END)::BIGINT AS burden, count(*) AS runs FROM analytics_runs GROUP BY operation",
    "e07_failure_labels": "SELECT array_to_string(list_filter([CASE WHEN NOT success THEN 'runtime' END, CASE WHEN latency_ms >= 5000 THEN 'slow' END, CASE WHEN NOT proof_usable THEN 'proof' END, CASE WHEN coalesce(chunk_count, 0) = 0 THEN 'empty' END, CASE WHEN coalesce(latency_ms, -1) < 0 THEN 'no_latency' END], lambda x: x IS NOT NULL), ',') AS labels, count(*) AS runs FROM analytics_runs GROUP BY 1",
    "e08_lossiness": "WITH r AS (SELECT operation, round(greatest(0, 1 - final_context_chars / raw_fetch_chars) * 0.3 + CASE WHEN proof_usable THEN 0 ELSE 0.7 END, 6) AS risk FROM analytics_runs WHERE raw_fetch_chars > 0 AND final_context_chars >= 0) SELECT operation, CASE WHEN risk >= 0.45 THEN 'high' WHEN risk >= 0.20 THEN 'medium' ELSE 'low' END AS level, count(*) AS runs FROM r GROUP BY 1, 2",
    "t01_appended_stream": "SELECT run_id, completed_at, operation, latency_ms FROM analytics_runs",
    "t02_upserted_stream": "SELECT url, doc_id, source, observed_at FROM documents QUALIFY row_number() OVER (PARTITION BY url ORDER BY observed_at DESC, doc_id DESC) = 1",
    "t03_host_stream": "SELECT lower(host) AS host, count(*) AS seen, max(n_chars) AS most_chars, max(coalesce(changed_recently, false)::INTEGER) AS ever_changed FROM documents WHERE trim(host) <> '' GROUP BY 1",
    "t06_provider_stream": """
WITH e AS (SELECT provider, completed_at, run_id, CASE WHEN success THEN 'success' WHEN latency_ms >= 5000 THEN 'timeout' ELSE 'failure' END AS outcome FROM analytics_runs WHERE trim(provider) <> ''),
l AS (SELECT provider, max((completed_at, run_id)) FILTER (outcome = 'success') AS last_success FROM e GROUP BY provider)
SELECT e.provider, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER (outcome = 'failure') AS failure, count(*) FILTER (outcome <> 'success' AND (last_success IS NULL OR (completed_at, run_id) > last_success)) AS consecutive FROM e JOIN l USING (provider) GROUP BY e.provider""",
    "t08_delta_stream": """
WITH r AS (SELECT DISTINCT document_id, snapshot_no, lower(trim(fingerprint)) AS fp FROM fingerprint_records WHERE fingerprint IS NOT NULL AND document_id IS NOT NULL),
s AS (SELECT document_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY document_id ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT document_id, snapshot_no FROM r))
SELECT s.document_id, s.snapshot_no, (SELECT count(*) FROM r a JOIN r b USING (document_id, fp) WHERE a.document_id = s.document_id AND a.snapshot_no = s.snapshot_no AND b.snapshot_no = s.before) AS retained,
  (SELECT count(*) FROM r a WHERE a.document_id = s.document_id AND a.snapshot_no = s.snapshot_no AND NOT EXISTS (SELECT 1 FROM r b WHERE b.document_id = a.document_id AND b.fp = a.fp AND b.snapshot_no = s.before)) AS added,
  (SELECT count(*) FROM r a WHERE a.document_id = s.document_id AND a.snapshot_no = s.before AND NOT EXISTS (SELECT 1 FROM r b WHERE b.document_id = a.document_id AND b.fp = a.fp AND b.snapshot_no = s.snapshot_no)) AS removed FROM s""",
    "t10_daily_stream": "SELECT strftime(completed_at, '%Y-%m-%d') AS day, count(*) AS run_count, count(*) FILTER (success) AS successful_runs, coalesce(trunc(avg(latency_ms))::BIGINT, 0) AS avg_latency_ms, coalesce(sum(greatest(raw_fetch_chars - final_context_chars, 0)), 0)::BIGINT AS chars_saved FROM analytics_runs WHERE completed_at IS NOT NULL GROUP BY 1",
    "x_tumbling_stream": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "x_sliding_stream": "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2",
    "x_session_stream": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}

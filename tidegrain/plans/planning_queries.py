"""Queries of choices, plans, records and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain import engine
from tidegrain.functions import text as T
from tidegrain.functions import urls
from tidegrain.functions.vectors import embed
from tidegrain.operators import discovery, keyed, packets, pages, ranking, retrieval, selection
from tidegrain.plans.page_queries import _RANKED, ranked_chunk_rows
from tidegrain.runtime import stage
from tidegrain.sources import search
from tidegrain.sources.tables import table


def _last_prints(spark: SparkSession, root: str) -> DataFrame:
    """The fingerprints of the last snapshot."""
    rows = table(spark, root, "fingerprint_records")
    return rows.where(F.col("snapshot_no") == F.lit(rows.agg(F.max("snapshot_no")).first()[0]))


def _ranked(spark: SparkSession, root: str) -> DataFrame:
    """Ranked chunks; stable ones have a fingerprint of the last snapshot."""
    rows = ranking.ranked(ranked_chunk_rows(spark, root), "doc_id").select("doc_id", "chunk_no", "text", "heading_path", "rank")
    prints = table(spark, root, "chunks").groupBy("chunk_no").agg(F.max(F.lower(F.trim("fingerprint"))).alias("fp"))
    last = _last_prints(spark, root).groupBy(F.col("document_id").alias("doc_id"), F.lower(F.trim("fingerprint")).alias("fp")).agg(F.min("saved_at").alias("saved"))
    joined = rows.join(prints, "chunk_no", "left").join(last, ["doc_id", "fp"], "left")
    return joined.select("doc_id", "chunk_no", "text", "heading_path", "rank", F.col("saved").isNotNull().alias("stable"), F.coalesce(F.unix_micros(F.col("saved").cast("timestamp")), F.lit(0)).alias("stable_order"))


def pack02_evidence(spark: SparkSession, root: str) -> DataFrame:
    """What the nodes of each segment tell of it."""
    raw = table(spark, root, "raw_pages").select("page_no", "url", "html")
    parts = pages.segments(raw).dropDuplicates(["page_no", "idx"]).select("page_no", "idx", "kind", F.explode("node_paths").alias("path"))
    nodes = pages.nodes(raw).dropDuplicates(["page_no", "pos"]).select("page_no", "path", F.col("kind").alias("node_kind"), "depth")
    joined = parts.join(nodes, ["page_no", "path"], "left")
    return joined.groupBy("page_no", "idx").agg(F.max(F.col("kind") == F.col("node_kind")).alias("kind_match"), F.avg("depth").alias("mean_depth"), F.count("*").alias("nodes"))


def pack10_novelty(spark: SparkSession, root: str) -> DataFrame:
    rows = ranking.ranked(ranked_chunk_rows(spark, root), "doc_id").select("doc_id", "chunk_no", "score")
    prints = table(spark, root, "chunks").groupBy("chunk_no").agg(F.max(F.lower(F.trim("fingerprint"))).alias("fingerprint"))
    stable = _last_prints(spark, root).select(F.col("document_id").alias("doc_id"), F.lower(F.trim("fingerprint")).alias("fingerprint"))
    found = ranking.novelty_biased(rows.join(prints, "chunk_no"), stable, "doc_id")
    return found.select("chunk_no", F.round("score", 6).alias("score"), "stable")


def pack14_stable_gate(spark: SparkSession, root: str) -> DataFrame:
    return selection.stable_gate(_ranked(spark, root), "doc_id", 1).select("doc_id", "chunk_no", "rank", "stable")


def pack15_partly_reused(spark: SparkSession, root: str) -> DataFrame:
    return selection.partly_reused(_ranked(spark, root), "doc_id", 3).select("doc_id", "chunk_no", "place")


def pack26_patches(spark: SparkSession, root: str) -> DataFrame:
    """Patches that choose the first proof of each document, applied."""
    rows = table(spark, root, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.from_json("proof_refs_json", "array<string>"), F.array().cast("array<string>")).alias("candidates"), F.array(F.lit("none")).alias("selected"), "stable_ratio")
    body = F.to_json(F.struct(F.slice("candidates", 1, 1).alias("selected"), F.coalesce(F.nanvl("stable_ratio", F.lit(0.0)), F.lit(0.0)).alias("confidence")))
    found = selection.patched(rows, rows.select("id", body.alias("body")))
    return found.groupBy("outcome").agg(F.count("*").alias("documents"))


def pack28_compacted(spark: SparkSession, root: str) -> DataFrame:
    rows = _ranked(spark, root).withColumn("utility", ranking.utility(F.col("text"), F.size("heading_path"))).drop("stable", "stable_order")
    return selection.compacted(rows, "doc_id").select("doc_id", "chunk_no", "rank")


def j14_regressions(spark: SparkSession, root: str) -> DataFrame:
    """Host reports of the earlier and the later half of the time, compared."""
    runs = table(spark, root, "analytics_runs").where("trim(host) != '' AND latency_ms >= 0 AND completed_at IS NOT NULL").withColumn("host", F.lower(F.trim("host")))
    report = lambda r: r.groupBy("host").agg(F.round(F.avg(F.col("success").cast("double")), 6).alias("passed"), F.round(F.avg("latency_ms"), 3).alias("latency"))
    cut = F.lit("2025-04-01").cast("timestamp_ntz")
    found = selection.regressions(report(runs.where(F.col("completed_at") < cut)), report(runs.where(F.col("completed_at") >= cut)), ["host"])
    return found.withColumn("worse", F.array_join("worse", ","))


def d24_decisions(spark: SparkSession, root: str) -> DataFrame:
    runs = keyed.newest(table(spark, root, "analytics_runs"), ["run_id"], ["completed_at", "latency_ms", "packet_bytes"])
    said = F.array_join(F.transform("decisions", lambda d: F.concat_ws(":", d["stage"], d["choice"], d["reason"])), " ")
    return selection.decisions(runs).select("run_id", said.alias("decisions"), F.array_join("missing", ",").alias("missing"))


def u04_missing_stages(spark: SparkSession, root: str) -> DataFrame:
    """Operations that a goal was never run with."""
    seen = table(spark, root, "analytics_runs").where("goal_hash IS NOT NULL").groupBy("goal_hash").agg(F.collect_set("operation").alias("ops"))  # of a fixed few operations
    return seen.select("goal_hash", F.array_join(F.array_sort(F.array_except(F.array(F.lit("query"), F.lit("read"), F.lit("crawl")), "ops")), ",").alias("missing"))


def v02_table_digests(spark: SparkSession, root: str) -> DataFrame:
    """Rows and order-free digests of the memory tables."""
    out = None
    for name in ("documents", "chunks", "topic_nodes", "topic_docs"):
        one = selection.digest(table(spark, root, name), name)
        out = one if out is None else out.unionAll(one)
    return out


def d05_same_site(spark: SparkSession, root: str) -> DataFrame:
    """The best links of each page for its own title."""
    raw = table(spark, root, "raw_pages").select("page_no", "url", "html").where("html IS NOT NULL")
    goals = raw.groupBy("url").agg(F.max(pages.title_by_pattern(F.col("html"))).alias("goal")).select(F.xxhash64("url").alias("query_id"), "goal", F.col("url").alias("seed_url"))
    return engine.discover(raw, goals)


def d07_probed(spark: SparkSession, root: str) -> DataFrame:
    """Candidates refined by what their pages show: title and headings."""
    raw = table(spark, root, "raw_pages").where("html IS NOT NULL")
    shown = pages.signals(pages.nodes(raw.select("page_no", "url", "html")).dropDuplicates(["page_no", "pos"]))
    titled = raw.groupBy("page_no", "url").agg(F.max(pages.title_by_pattern(F.col("html")) != "").alias("titled"))
    joined = titled.join(shown, "page_no", "left")
    score = F.lit(0.35) + urls.structure_boost(F.col("url")) + F.when(F.col("titled"), 0.35).otherwise(0.0) + F.when(F.coalesce("heading_ratio", F.lit(0.0)) > 0, 0.10).otherwise(0.0) + F.when(F.coalesce("embedded_count", F.lit(0)) > 0, 0.12).otherwise(0.0)
    return joined.select("page_no", "url", F.round(score, 6).alias("score"))


def _goals(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").select(F.col("item_id").alias("query_id"), "goal").where("goal IS NOT NULL")


def d14_local_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The known addresses most like each goal, often seen ones first."""
    known = table(spark, root, "documents").groupBy("url").agg(F.count("*").alias("seen"), F.max("title").alias("title"))
    words = F.lower(F.concat_ws(" ", "title", urls.token_text(F.col("url"))))
    stored = known.select("url", "seen", F.xxhash64("url").alias("vec_id"), embed(words).alias("vector"))
    asked = _goals(spark, root).select("query_id", embed(F.lower("goal")).alias("query_vector"))
    often = F.least("seen", F.lit(5)) * 0.15
    near = retrieval.best_scored(asked, stored.withColumn("bonus", often), 5, 3.0).drop("score").join(stored.select("vec_id", "url", "seen"), "vec_id")
    scored = near.withColumn("score", F.round(F.col("similarity") * 3 + often, 6)).drop("rank")
    return keyed.newest(scored, ["query_id"], ["score", "url"], 5).select("query_id", "url", "score")


def _memory_hits(spark: SparkSession, root: str, k: int) -> DataFrame:
    """(query_id, url, label): the known addresses most like each goal."""
    known = table(spark, root, "documents").groupBy("url").agg(F.max("title").alias("label"))
    stored = known.select("url", "label", F.xxhash64("url").alias("vec_id"), embed(F.lower(F.concat_ws(" ", "label", urls.token_text(F.col("url"))))).alias("vector"), F.lit(0.0).alias("bonus"))
    asked = _goals(spark, root).select("query_id", embed(F.lower("goal")).alias("query_vector"))
    return retrieval.best_scored(asked, stored, k).join(stored.select("vec_id", "url", "label"), "vec_id").select("query_id", "url", "label")


def _page_texts(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "raw_pages").select("page_no", "url", "html", "content_type")
    nodes = pages.nodes(raw).dropDuplicates(["page_no", "pos"])
    return nodes.select("page_no", "pos", "text").join(raw.select("page_no", "url").distinct(), "page_no")


def d06_web_discovery(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of three providers over the collection, composed: memory,
    links of the pages it knows, and addresses in their texts."""
    hits = stage(_memory_hits(spark, root, 10))
    links = pages.page_links(table(spark, root, "raw_pages").select("page_no", "url", "html")).groupBy("url", F.col("target")).agg(F.max("label").alias("text"))
    linked = hits.select("query_id", "url").join(links, "url").select("query_id", F.lit("links").alias("provider"), F.col("target").alias("url"), F.col("text").alias("label"))
    literal = discovery.literal_candidates(_page_texts(spark, root)).select("source", F.col("url").alias("target"))
    said = hits.join(literal, F.col("url") == F.col("source")).select("query_id", F.lit("literal").alias("provider"), F.col("target").alias("url"), "label")
    found = hits.select("query_id", F.lit("memory").alias("provider"), "url", "label").unionByName(linked).unionByName(said)
    found = found.withColumn("score", discovery.candidate_score(F.col("url")))
    return discovery.web_discovery(found, _goals(spark, root)).withColumn("providers", F.array_join("providers", ","))


def d12_literal_candidates(spark: SparkSession, root: str) -> DataFrame:
    return discovery.literal_candidates(_page_texts(spark, root)).select("page_no", "url", F.round("score", 6).alias("score"), "rank")


def d21_rewrites(spark: SparkSession, root: str) -> DataFrame:
    """Queries to ask for a document: its title, its summary's head, its words."""
    lines = F.concat_ws("\n", "title", T.head(F.col("semantic_summary"), 60), urls.token_text(F.col("url")))
    return table(spark, root, "documents").select("doc_id", F.to_json(selection.normalized_rewrites(lines)).alias("queries"))


def d22_prepared(spark: SparkSession, root: str) -> DataFrame:
    """Goals with their best local candidate and what is known of its site."""
    best = keyed.newest(d14_local_candidates(spark, root), ["query_id"], ["score", "url"])
    hosts = table(spark, root, "documents").where("trim(host) != ''").groupBy(F.lower("host").alias("host")).agg(F.count("*").alias("seen"), F.bool_or(F.coalesce("changed_recently", F.lit(False))).alias("changed"))
    joined = _goals(spark, root).join(best, "query_id", "left").withColumn("host", urls.host(F.col("url")))
    return joined.join(hosts, "host", "left").select("query_id", "url", "score", "host", "seen", "changed")


def d17_observed(spark: SparkSession, root: str) -> DataFrame:
    """Memory rows of all pages."""
    raw = table(spark, root, "raw_pages").select("page_no", "url", "html")
    rows = engine.observe(packets.packets(raw), F.lit("2025-05-01").cast("timestamp_ntz"))
    return rows.select("url", "host", "path", "summary", "embedding_ref")


def d25_run_records(spark: SparkSession, root: str) -> DataFrame:
    """Run facts of reading every page."""
    raw = table(spark, root, "raw_pages")
    made = packets.packets(raw.select("page_no", "url", "html")).select("page_no", "chunk_count", "packet_bytes")
    facts = raw.groupBy("page_no").agg(
        F.max("url").alias("url"), F.max("retry_count").alias("retries"), F.max(F.length("html")).alias("raw_fetch_chars"), F.max(F.octet_length("html")).alias("raw_fetch_bytes"), F.max(F.col("retry_sleep_ms") + F.col("host_pacing_ms")).alias("waited_ms"),
    )
    nodes = pages.nodes(raw.select("page_no", "url", "html")).dropDuplicates(["page_no", "pos"]).groupBy("page_no").agg(F.count("*").alias("reduced_node_count"), F.sum(F.length("text")).alias("reduced_chars"))
    joined = facts.join(made, "page_no", "left").join(nodes, "page_no", "left")
    return joined.select("page_no", urls.host(F.col("url")).alias("host"), F.lit("read").alias("operation"), "retries", "raw_fetch_chars", "raw_fetch_bytes", "waited_ms", "chunk_count", F.col("packet_bytes").alias("final_context_chars"), "reduced_node_count", "reduced_chars")


def s12_provider_names(spark: SparkSession, root: str) -> DataFrame:
    """Search addresses of the goals at a provider, by the provider's name."""
    base = F.lit("https://search.example/html?kl=x")
    return _goals(spark, root).select("query_id", search.provider_name(base).alias("provider"), search.search_address(base, F.col("goal")).alias("address"))


def l18_vector_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Vectors by whether they are fit for search."""
    rows = table(spark, root, "topic_docs").select("vec_id", "vector")
    fit = retrieval.fit_vectors(rows).select("vec_id", F.lit(1).alias("fit"))
    return rows.join(fit.distinct(), "vec_id", "left").groupBy(F.size("vector").alias("dimensions"), F.col("fit").isNotNull().alias("fit")).agg(F.count("*").alias("vectors"))


QUERIES = {
    f.__name__: f
    for f in (
        d05_same_site, d06_web_discovery, d12_literal_candidates, d07_probed, d14_local_candidates, d17_observed, d21_rewrites, d22_prepared, d24_decisions, d25_run_records, j14_regressions, l18_vector_bytes, pack02_evidence, pack10_novelty, pack14_stable_gate, pack15_partly_reused,
        pack26_patches, pack28_compacted, s12_provider_names, u04_missing_stages, v02_table_digests,
    )
}

_STABLE = """, fp AS (SELECT chunk_no, max(lower(trim(fingerprint))) AS fp FROM chunks GROUP BY chunk_no), last4 AS (SELECT DISTINCT document_id AS doc_id, lower(trim(fingerprint)) AS fp FROM fingerprint_records WHERE snapshot_no = (SELECT max(snapshot_no) FROM fingerprint_records)),
g AS (SELECT r.*, l.fp IS NOT NULL AS stable FROM ranked r LEFT JOIN fp USING (chunk_no) LEFT JOIN last4 l ON l.doc_id = r.doc_id AND l.fp = fp.fp)"""

SQL = {
    "pack10_novelty": _RANKED + _STABLE + ", k AS (SELECT DISTINCT doc_id FROM last4) SELECT chunk_no, round(least(greatest(score + CASE WHEN k.doc_id IS NULL THEN 0 WHEN stable THEN -0.05 ELSE 0.05 END, 0), 1), 6) AS score, stable FROM g LEFT JOIN k USING (doc_id)",
    "pack14_stable_gate": _RANKED + _STABLE + """, w AS (SELECT *, max(CASE WHEN rank <= 1 AND stable THEN 1 END) OVER (PARTITION BY doc_id) AS has, min(CASE WHEN rank > 1 AND stable THEN rank END) OVER (PARTITION BY doc_id) AS best FROM g)
SELECT doc_id, chunk_no, rank, stable FROM w WHERE CASE WHEN has IS NULL AND best IS NOT NULL THEN rank < 1 OR rank = best ELSE rank <= 1 END""".replace(", w AS", ", w2 AS").replace("FROM w WHERE", "FROM w2 WHERE"),
    "pack26_patches": """
WITH d AS (SELECT coalesce(from_json(proof_refs_json, '["VARCHAR"]'), []) AS c, CASE WHEN stable_ratio IS NULL OR isnan(stable_ratio) THEN 0 ELSE stable_ratio END AS s FROM documents)
SELECT CASE WHEN len(c) = 0 THEN 'empty' WHEN s >= 0.78 THEN 'applied' ELSE 'unsure' END AS outcome, count(*) AS documents FROM d GROUP BY 1""",
    "j14_regressions": """
WITH r AS (SELECT lower(trim(host)) AS host, success, latency_ms, completed_at < TIMESTAMP '2025-04-01' AS early FROM analytics_runs WHERE trim(host) <> '' AND latency_ms >= 0 AND completed_at IS NOT NULL),
g AS (SELECT host, early, round(avg(success::INT), 6) AS passed, round(avg(latency_ms), 3) AS latency FROM r GROUP BY 1, 2)
SELECT a.host, a.passed AS old_passed, b.passed, a.latency AS old_latency, b.latency, array_to_string(list_filter([CASE WHEN b.passed < a.passed THEN 'pass_rate' END, CASE WHEN b.latency > a.latency * 1.2 THEN 'latency' END], lambda x: x IS NOT NULL), ',') AS worse
FROM g a JOIN g b ON a.host = b.host AND a.early AND NOT b.early""",
    "d24_decisions": """
WITH r AS (SELECT * FROM analytics_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC NULLS LAST, latency_ms DESC NULLS LAST, packet_bytes DESC NULLS LAST) = 1)
SELECT run_id, 'mode:' || coalesce(discovery_mode, 'off') || ':' || CASE WHEN seed_present THEN 'seed_given' ELSE 'no_seed' END || ' budget:' || coalesce(profile, 'standard') || ':' || CASE WHEN profile = 'tiny' THEN 'latency_constrained' ELSE 'default' END
  || ' memory:' || CASE WHEN local_memory_used THEN 'used' ELSE 'unused' END || ':' || CASE WHEN topic_node_used THEN 'topic_node' ELSE 'none' END || ' discovery:' || coalesce(provider, 'none') || ':' || CASE WHEN candidate_count <= 1 THEN 'low_candidate_set' ELSE 'candidates' END
  || ' selection:' || CASE WHEN selected_url IS NOT NULL THEN 'selected' ELSE 'none' END || ':' || CASE WHEN same_site_recovery_used THEN 'recovered' ELSE 'first' END AS decisions,
  array_to_string(list_filter([CASE WHEN coalesce(provider, 'none') = 'none' THEN 'discovery' END, CASE WHEN selected_url IS NULL THEN 'selection' END], lambda x: x IS NOT NULL), ',') AS missing FROM r""",
    "u04_missing_stages": "SELECT goal_hash, array_to_string(list_sort(list_filter(['query', 'read', 'crawl'], lambda x: NOT list_contains(list(DISTINCT operation), x))), ',') AS missing FROM analytics_runs WHERE goal_hash IS NOT NULL GROUP BY goal_hash",
    "l18_vector_bytes": "WITH f AS (SELECT vec_id, len(vector)::INTEGER AS dimensions, coalesce(len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0, false) AS fit FROM topic_docs) SELECT dimensions, fit, count(*) AS vectors FROM f GROUP BY 1, 2",
}

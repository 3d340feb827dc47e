"""Queries over the document memory: texts, addresses, keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrain.functions import text as T
from tidegrain.functions import urls
from tidegrain.functions.values import content_id, findings, first_filled, piped_id
from tidegrain.functions.vectors import embed
from tidegrain.operators import discovery, keyed
from tidegrain.operators.retrieval import host_pages
from tidegrain.plans.document_sql import SQL
from tidegrain.sources.tables import table


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).where("text IS NOT NULL").select("doc_id", "text")


def l01_text_measures(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, root).select(
        "doc_id", F.octet_length(t).alias("bytes"), F.length(t).alias("chars"), T.marks(t).alias("marks"), T.word_count(t).alias("words"), T.line_count(t).alias("lines"), T.sentence_count(t).alias("sentences"),
        F.round(T.word_bytes(t), 6).alias("word_bytes"), F.round(T.title_like_share(t), 6).alias("title_like"), F.size(T.long_tokens(t)).alias("long_tokens"),
    )


def h14_one_line(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("doc_id", T.one_line(F.col("text")).alias("text"))


def h12_junk(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).groupBy(T.looks_like_junk(F.col("text")).alias("junk")).agg(F.count("*").alias("documents"))


def h19_literal_urls(spark: SparkSession, root: str) -> DataFrame:
    """Distinct addresses that stand in html, without closing marks."""
    found = F.explode(F.regexp_extract_all("html", F.lit(r"https?://[^\s\"'<>()]+"), F.lit(0)))
    pages = table(spark, root, "raw_pages").where("html IS NOT NULL").select("page_no", found.alias("url"))
    return pages.select("page_no", F.regexp_replace("url", r"[.,;:!?]+$", "").alias("url")).distinct()


def pack18_shortest(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("doc_id", T.shortest(F.col("text")).alias("short"))


def pack19_focus_spans(spark: SparkSession, root: str) -> DataFrame:
    """The sentence of each text that holds most words of its title."""
    rows = _documents(spark, root).where("text IS NOT NULL AND trim(title) != ''")
    spans = rows.select("doc_id", T.long_tokens(F.col("title")).alias("terms"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    hits = F.size(F.array_intersect("terms", T.long_tokens(F.col("sentence"))))
    best = spans.groupBy("doc_id").agg(F.max(F.struct(hits.alias("hits"), (-F.col("pos")).alias("p"), "sentence")).alias("b"))
    return best.select("doc_id", "b.hits", (-F.col("b.p")).alias("pos"), "b.sentence")


def pack20_formatted(spark: SparkSession, root: str) -> DataFrame:
    """One line of at most 160 characters with a mark at its end."""
    cut = T.head(F.col("text"), 160)
    return _texts(spark, root).select("doc_id", F.when(cut.rlike(r"[.!?]$") | (cut == ""), cut).otherwise(F.concat(cut, F.lit("."))).alias("text"))


def pack27_token_budget(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, root).select("doc_id", T.token_estimate(t).alias("tokens"), T.first_tokens(t, 48).alias("head"))


def pack29_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The head of each text, after its title if it is short and lacks it."""
    head = T.head(F.col("text"), 220)
    title = T.one_line(F.coalesce("title", F.lit("")))
    prefix = (title != "") & (head != "") & (F.length(head) <= 110) & ~F.lower(head).contains(F.lower(title)) & ~F.lower(title).contains(F.lower(head))
    return _documents(spark, root).where("text IS NOT NULL").select("doc_id", F.when(prefix, F.concat(title, F.lit(": "), head)).otherwise(head).alias("summary"))


def pack30_display(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("doc_id", T.display(F.col("text")).alias("text"))


def pack32_savings(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "analytics_runs").where("run_id IS NOT NULL")
    saved = F.greatest(F.col("raw_fetch_chars") - F.col("final_context_chars"), F.lit(0))
    return rows.groupBy("run_id").agg(F.max(saved).alias("saved"), F.round(F.max(F.when(F.col("raw_fetch_chars") > 0, saved / F.col("raw_fetch_chars")).otherwise(0.0)), 6).alias("share"))


def v03_findings(spark: SparkSession, root: str) -> DataFrame:
    """What is wrong with each document row, by count of rows."""
    unit = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & ~F.col(c).between(0, 1)
    wrong = findings(
        (F.col("text").isNull(), "no_text"), (F.coalesce(F.trim("title"), F.lit("")) == "", "no_title"), (F.col("stable_ratio").isNull(), "no_ratio"), (unit("stable_ratio") | unit("novelty_ratio"), "ratio_out_of_range"),
        (F.col("n_chars").isNull(), "no_size"), (F.col("n_chars") != F.length("text"), "wrong_size"), (F.col("updated_at") < F.col("observed_at"), "updated_before_observed"),
    )
    return _documents(spark, root).groupBy(F.array_join(wrong, ",").alias("findings")).agg(F.count("*").alias("documents"))


def v04_content_ids(spark: SparkSession, root: str) -> DataFrame:
    rows = _documents(spark, root)
    return rows.select("doc_id", content_id("doc", F.col("url"), F.col("text")).alias("content_id"), piped_id("mem", F.col("url"), F.col("title")).alias("piped_id"))


def l12_url_parts(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url")
    host = urls.host(u)
    return _documents(spark, root).select("doc_id", host.alias("host"), urls.path(u).alias("path"), urls.depth(urls.path(u)).alias("depth"), urls.family(host).alias("family"), urls.token_text(u).alias("tokens"), urls.canonical(u).alias("canonical"))


def l15_ancestors(spark: SparkSession, root: str) -> DataFrame:
    """Documents below each path of each host."""
    u = F.col("url")
    rows = _documents(spark, root).select(urls.host(u).alias("host"), F.explode(urls.ancestors(urls.path(u))).alias("root_path"), "url")
    return rows.groupBy("host", "root_path").agg(F.count_distinct("url").alias("support"))


def d01_candidate_scores(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url")
    rows = _documents(spark, root).select("url").distinct()
    return rows.select("url", F.round(discovery.candidate_score(u), 6).alias("score"), F.array_join(discovery.candidate_reasons(u), ",").alias("reasons"))


def d02_structure(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url")
    host = urls.host(u)
    rows = _documents(spark, root).select("url").distinct()
    return rows.select("url", F.round(urls.structure_boost(u), 6).alias("structure"), urls.resource_class(urls.path(u)).alias("resource"), F.round(urls.compactness(host), 6).alias("compact"))


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url")
    rows = _documents(spark, root).select("url").distinct()
    return rows.select("url", urls.host(u).alias("host"), urls.family(urls.host(u)).alias("family"), urls.depth(urls.path(u)).alias("depth"), F.round(discovery.candidate_score(u), 6).alias("score"))


def d08_shallow_preferred(spark: SparkSession, root: str) -> DataFrame:
    found = discovery.shallow_preferred(_candidates(spark, root))
    return found.select("url", "score", F.round("boosted", 4).alias("boosted"))


def o02_candidate_order(spark: SparkSession, root: str) -> DataFrame:
    return _candidates(spark, root).orderBy(F.desc("score"), "url").limit(100).select("url", "score")


def o06_first_per_family(spark: SparkSession, root: str) -> DataFrame:
    return discovery.first_per_family(_candidates(spark, root), 50).select("family", "url", "score")


def d24_margins(spark: SparkSession, root: str) -> DataFrame:
    return discovery.margins(_candidates(spark, root), "family")


def j15_evidence_rerank(spark: SparkSession, root: str) -> DataFrame:
    latest = keyed.newest(_documents(spark, root), ["url"], ["observed_at", "doc_id"]).select("url", "stable_ratio", "novelty_ratio", "changed_recently")
    found = discovery.evidence_reranked(_candidates(spark, root), latest)
    return found.select("url", F.round("reranked", 6).alias("reranked"))


def a14_host_seeds(spark: SparkSession, root: str) -> DataFrame:
    """The best candidate of the host whose best and summed scores are best,
    per family."""
    rows = _candidates(spark, root)
    hosts = rows.groupBy("family", "host").agg(F.sum("score").alias("total"), F.max(F.struct("score", "url")).alias("best"))
    value = F.round(F.col("best.score") + F.col("total") * 0.35, 4)
    best = hosts.groupBy("family").agg(F.max(F.struct(value.alias("value"), F.col("best.url").alias("url"))).alias("b"))
    return best.select("family", "b.url", "b.value")


def a17_merged_candidates(spark: SparkSession, root: str) -> DataFrame:
    rows = _documents(spark, root).select("url", F.col("title").alias("label"), F.round(discovery.candidate_score(F.col("url")) + F.coalesce(F.nanvl("novelty_ratio", F.lit(0.0)), F.lit(0.0)), 6).alias("score"), F.array("source_kind").alias("reasons"))
    merged = keyed.max_merge(rows)
    return merged.select("url", "score", "label", F.array_join("reasons", ",").alias("reasons"), "sources")


def a06_memory_stats(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the memory tables and the latest observation, each in one pass."""
    documents = _documents(spark, root).agg(F.lit("documents").alias("name"), F.count("*").alias("n"), F.max("observed_at").alias("last"))
    topics = table(spark, root, "topic_nodes").agg(F.lit("topic_nodes").alias("name"), F.count("*").alias("n"), F.max("observed_at").alias("last"))
    vectors = table(spark, root, "topic_docs").agg(F.lit("topic_docs").alias("name"), F.count("*").alias("n"), F.max("observed_at").alias("last"))
    return documents.unionAll(topics).unionAll(vectors)


def a11_seen_counts(spark: SparkSession, root: str) -> DataFrame:
    seen = keyed.seen_counts(_documents(spark, root), "url", "observed_at", "source")
    return seen.withColumn("sources", F.array_join("sources", ","))


def a12_host_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Folds of each host's observations: most, last not blank, any, count."""
    at = F.struct("observed_at", "doc_id")
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    last = lambda c: F.max_by(filled(c), F.when(filled(c).isNotNull(), at)).alias(c)
    return _documents(spark, root).where("trim(host) != ''").groupBy(F.lower("host").alias("host")).agg(F.count("*").alias("seen"), F.max("n_chars").alias("most_chars"), last("lang"), last("title"), F.bool_or(F.coalesce("changed_recently", F.lit(False))).alias("ever_changed"))


def k01_upserted_documents(spark: SparkSession, root: str) -> DataFrame:
    """Crawled documents updated by all others: the newest row per url."""
    rows = _documents(spark, root).select("url", "doc_id", "source", "observed_at")
    return keyed.upsert(rows.where("source = 'crawl'"), rows.where("source IS NULL OR source != 'crawl'"), ["url"], ["observed_at", "doc_id"])


def k04_export_order(spark: SparkSession, root: str) -> DataFrame:
    """Documents in the order of their export."""
    return _documents(spark, root).select("url", "observed_at", "doc_id").orderBy(F.desc("observed_at"), "url", "doc_id")


def k07_pruned_documents(spark: SparkSession, root: str) -> DataFrame:
    return keyed.pruned(_documents(spark, root), "observed_at", F.lit("2025-03-20").cast("timestamp_ntz")).groupBy("source_kind").agg(F.count("*").alias("kept"))


def k08_retained_documents(spark: SparkSession, root: str) -> DataFrame:
    """The newest 300 documents, the reference's way to bound its memory."""
    return keyed.retained(_documents(spark, root), [F.desc("observed_at"), F.col("url"), F.col("doc_id")], 300).select("doc_id", "url")


def o05_latest_per_host(spark: SparkSession, root: str) -> DataFrame:
    rows = _documents(spark, root).groupBy("url").agg(F.max(F.struct("observed_at", F.lower("host").alias("host"), "path")).alias("d")).select("url", "d.*")
    return host_pages(rows, 3).select("host", "url", "rank")


def u01_union_max(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of pages and documents together, with the latest time."""
    pages = table(spark, root, "raw_pages").select("url", F.col("fetched_at").alias("seen_at"))
    both = _documents(spark, root).select("url", F.col("observed_at").alias("seen_at")).unionByName(pages)
    return both.where("url IS NOT NULL").groupBy("url").agg(F.max("seen_at").alias("seen_at"), F.count("*").alias("n"))


def u02_distinct_hints(spark: SparkSession, root: str) -> DataFrame:
    """The distinct hints of each document, in order, blanks left out."""
    listed = F.concat(*(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in ("entity_hints_json", "category_hints_json", "locality_hints_json")))
    return _documents(spark, root).select("doc_id", F.to_json(F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""))).alias("hints"))


def u03_fetched_only(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of documents that were fetched, and that were not."""
    documents, pages = _documents(spark, root).select("url"), table(spark, root, "raw_pages").select("url")
    both = documents.intersect(pages).withColumn("found", F.lit("both"))
    return both.unionByName(documents.subtract(pages).withColumn("found", F.lit("document_only")))


def j10_fetched_documents(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).join(table(spark, root, "raw_pages"), "url", "left_semi").select("doc_id")


def j11_unfetched_documents(spark: SparkSession, root: str) -> DataFrame:
    return _documents(spark, root).join(table(spark, root, "raw_pages"), "url", "left_anti").select("doc_id")


def j07_agent_context(spark: SparkSession, root: str) -> DataFrame:
    """Chunks with their document and its first proof reference."""
    chunks = table(spark, root, "chunks").groupBy("chunk_no").agg(F.max(F.struct("chunk_id", "doc_id", "score")).alias("c")).select("chunk_no", "c.*")
    documents = _documents(spark, root).select("doc_id", "url", first_filled(F.col("title"), F.col("url")).alias("label"), F.get(F.from_json("proof_refs_json", "array<string>"), F.lit(0)).alias("proof_id"))
    return chunks.join(documents, "doc_id", "left").select("chunk_no", "chunk_id", "url", "label", "proof_id", F.round("score", 6).alias("score"))


def j08_fingerprint_delta(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints retained, added and removed by each snapshot, counted."""
    rows = table(spark, root, "fingerprint_records").select("snapshot_no", "document_id", F.lower(F.trim("fingerprint")).alias("fp"))
    found = keyed.delta(*keyed.transitions(rows), ["snapshot_no", "document_id", "fp"])
    return found.groupBy("snapshot_no", "document_id", "status").agg(F.count("*").alias("n"))


def j09_title_changes(spark: SparkSession, root: str) -> DataFrame:
    """Titles of addresses that differ from the snapshot before."""
    rows = table(spark, root, "document_snapshots").select("snapshot_no", F.lower(F.trim("url")).alias("url"), "title", "updated_at", "delivered_at")
    last = keyed.newest(rows, ["snapshot_no", "url"], ["updated_at", "delivered_at", "title"])
    return keyed.changed_values(*keyed.transitions(last), ["snapshot_no", "url"], "title")


def j06_scored_join(spark: SparkSession, root: str) -> DataFrame:
    """Candidates with the summed score of their chunks, zero without."""
    chunks = table(spark, root, "chunks").groupBy("chunk_no").agg(F.max(F.struct("doc_id", "score")).alias("c")).groupBy("c.doc_id").agg(F.avg("c.score").alias("s"))
    rows = _documents(spark, root).select("doc_id", "url").join(chunks, "doc_id", "left")
    return rows.select("doc_id", F.round(discovery.candidate_score(F.col("url")) + 3 * F.coalesce("s", F.lit(0.0)), 6).alias("score"))


def e01_fidelity(spark: SparkSession, root: str) -> DataFrame:
    """Share of a document's hints that its text holds."""
    terms = F.coalesce(F.from_json("entity_hints_json", "array<string>"), F.array().cast("array<string>"))
    rows = _documents(spark, root).select("doc_id", terms.alias("terms"), F.coalesce("text", F.lit("")).alias("text"))
    hit = F.size(F.filter("terms", lambda t: F.contains(F.col("text"), t)))
    return rows.select("doc_id", F.size("terms").alias("expected"), hit.alias("found"), F.round(F.when(F.size("terms") == 0, 1.0).otherwise(hit / F.size("terms")), 6).alias("fidelity"))


def e02_compression(spark: SparkSession, root: str) -> DataFrame:
    """Words of the html against words of its nodes."""
    words = lambda c: F.size(T.fields(F.col(c)))
    raw = table(spark, root, "raw_pages").where("html IS NOT NULL").groupBy("page_no").agg(F.max(words("html")).alias("raw"))
    kept = table(spark, root, "simplified_nodes").groupBy("page_no", "pos").agg(F.max("text").alias("text")).groupBy("page_no").agg(F.sum(words("text")).alias("kept"))
    return raw.join(kept, "page_no").select("page_no", "raw", "kept", F.round(F.when(F.col("kept") > 0, F.col("raw") / F.col("kept")).otherwise(0.0), 6).alias("ratio"))


def e03_density(spark: SparkSession, root: str) -> DataFrame:
    """Share of distinct words among the words of a text."""
    words = T.fields(F.lower("text"))
    return _texts(spark, root).select("doc_id", F.round(F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0), 6).alias("density"))


def e04_fact_coverage(spark: SparkSession, root: str) -> DataFrame:
    """The words of a title that its text covers, and the missing ones."""
    rows = _documents(spark, root).where("text IS NOT NULL AND trim(title) != ''").select("doc_id", "text", T.long_tokens(F.col("title")).alias("terms"))
    hit = T.covered(F.col("text"), F.col("terms"))
    return rows.select("doc_id", F.array_join(hit, " ").alias("covered"), F.array_join(F.array_except("terms", hit), " ").alias("missing"))


def e09_noise_hits(spark: SparkSession, root: str) -> DataFrame:
    """Lines of chunks that hold a noise term."""
    terms = ["cookie", "newsletter", "privacy", "all rights reserved", "follow"]
    rows = table(spark, root, "chunks").groupBy("chunk_no").agg(F.max("text").alias("text")).where("text IS NOT NULL")
    hits = F.size(F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(F.lower("text"), t)))
    return rows.select("chunk_no", hits.alias("hits"))


def e10_embedded_texts(spark: SparkSession, root: str) -> DataFrame:
    """Hash vectors of the summaries."""
    rows = _documents(spark, root).where("semantic_summary IS NOT NULL")
    return rows.select("doc_id", embed(F.col("semantic_summary")).alias("vector"))


def pack13_exact_repeats(spark: SparkSession, root: str) -> DataFrame:
    """Documents by normalized text: how many hold it, the first of them."""
    norm = T.one_line(F.lower("text"))
    rows = _texts(spark, root).select("doc_id", F.sha2(norm, 256).alias("digest"), (norm == "").alias("empty")).where("NOT empty")
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def o10_promoted(spark: SparkSession, root: str) -> DataFrame:
    """The newest document of each host lifted above the host's other scores."""
    rows = _candidates(spark, root)
    newest = keyed.newest(_documents(spark, root).withColumn("host", F.lower("host")), ["host"], ["observed_at", "doc_id"]).select("host", F.col("url").alias("chosen"))
    top = rows.groupBy("host").agg(F.max("score").alias("top"))
    joined = rows.join(newest, "host", "left").join(top, "host")
    lifted = F.when(F.col("url") == F.col("chosen"), F.greatest(F.col("score") + 0.6, F.col("top") + 0.12)).otherwise(F.col("score"))
    return joined.select("url", F.round(lifted, 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        a06_memory_stats, a11_seen_counts, a12_host_profiles, a14_host_seeds, a17_merged_candidates, d01_candidate_scores, d02_structure,
        d08_shallow_preferred, d24_margins, e01_fidelity, e02_compression, e03_density, e04_fact_coverage, e09_noise_hits, e10_embedded_texts,
        h12_junk, h14_one_line, h19_literal_urls, j06_scored_join, j07_agent_context, j08_fingerprint_delta, j09_title_changes, j10_fetched_documents,
        j11_unfetched_documents, j15_evidence_rerank, k01_upserted_documents, k04_export_order, k07_pruned_documents, k08_retained_documents,
        l01_text_measures, l12_url_parts, l15_ancestors, o02_candidate_order, o05_latest_per_host, o06_first_per_family, o10_promoted,
        pack13_exact_repeats, pack18_shortest, pack19_focus_spans, pack20_formatted, pack27_token_budget, pack29_summaries, pack30_display,
        pack32_savings, u01_union_max, u02_distinct_hints, u03_fetched_only, v03_findings, v04_content_ids,
    )
}

__all__ = ["QUERIES", "SQL"]

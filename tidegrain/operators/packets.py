"""Pages to packets: read, rank, select, prove, assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.functions import text as T
from tidegrain.functions.values import content_id
from tidegrain.operators import pages as P
from tidegrain.operators import ranking as R


def ranked_segments(pages: DataFrame, profile: str = "standard", alignment: Column | None = None) -> DataFrame:
    """The ranked segments of each page, with ids.

    ``alignment`` says how well a segment meets an objective; without one it is
    0.  A page delivered twice counts once.
    """
    once = P.segments(pages).dropDuplicates(["page_no", "idx"])
    aligned = once.withColumn("alignment", F.lit(0.0) if alignment is None else alignment)
    out = R.ranked(aligned, "page_no")
    out = out.withColumn("fingerprint", content_id("fp", F.col("text"), F.array_join("heading_path", "\0")))
    return out.withColumn("chunk_id", content_id("chk", F.col("page_no"), F.col("fingerprint"), F.col("idx")))


def proof(row_id: Column, paths: Column, text: Column) -> Column:
    """Where a text comes from, and an id of that."""
    span = F.array_join(paths, "|")
    return F.struct(content_id("proof", row_id, span, F.octet_length(text)).alias("proof_id"), span.alias("source"), F.lit(0).alias("start"), F.octet_length(text).alias("end"))


def packets(pages: DataFrame, profile: str = "standard", alignment: Column | None = None) -> DataFrame:
    """One packet per page: its best segments with proof, outline, summary and
    what speaks against them."""
    ranked = ranked_segments(pages, profile, alignment).withColumn("stable", F.lit(False))
    limit = R.PROFILE_LIMITS[profile]
    chosen = ranked if limit is None else R.policy_selected(ranked, "page_no", limit, profile)
    chosen = R.deduplicated(chosen, "page_no") if profile == "tiny" else chosen
    unclear = R.ambiguity()
    marked = chosen.withColumn("ambiguity", unclear).withColumn("lane", R.lane(F.col("ambiguity"), profile)).withColumn("flags", R.risk_flags(F.col("ambiguity")))
    marked = marked.withColumn("proof", proof(F.col("chunk_id"), F.col("node_paths"), F.col("text")))
    item = F.struct("rank", "chunk_id", "kind", "heading_path", "text", "score", "confidence", "lane", "flags", "proof")
    grouped = marked.groupBy("page_no", "url", "title").agg(
        F.array_sort(F.collect_list(item)).alias("chunks"), F.sum(F.octet_length("text")).alias("packet_bytes"), F.max_by("confidence", -F.col("rank")).alias("top_confidence"), F.avg("ambiguity").alias("mean_ambiguity"),
    )
    paths = F.transform("chunks", lambda c: c["heading_path"])
    summary = T.head(F.get(F.transform("chunks", lambda c: c["text"]), F.lit(0)), 220)
    return grouped.select(
        "page_no", "url", "title", R.page_class(F.col("url")).alias("page_type"), "chunks", F.size("chunks").alias("chunk_count"), "packet_bytes", R.outline(paths).alias("outline"), summary.alias("summary"),
        F.round("top_confidence", 6).alias("top_confidence"), F.round("mean_ambiguity", 6).alias("mean_ambiguity"), F.array_sort(F.array_distinct(F.transform("chunks", lambda c: c["lane"]))).alias("lane_path"),
    )

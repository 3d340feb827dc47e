"""Lines that the documents of one source repeat excessively.

First pass: every source gets a mergeable summary of counters (one Count-Min
row whose width, a power of two, follows the source's own number of lines).
Summaries of partitions or days merge: the wider one is folded to the width of
the narrower one, and counters are added.  A counter never falls below the count
of any line in it, so a line that is repeated often enough is always among the
candidates.  Second pass: exact counts of distinct documents for the candidate
lines only.  The confirmed lines are then removed from each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.runtime import join_small, stage

#: Documents of a source in which a line has to occur to be excessive.
MIN_DOCUMENTS = 5
#: Counters per line occurrence of a source, at least, and at most twice that.
WIDTH_SHARE = 0.5


def line_key(line: Column) -> Column:
    """Lower case, digit runs as ``#``, white-space runs as one blank, trimmed."""
    masked = F.regexp_replace(F.lower(line), "[0-9]+", "#")
    return F.trim(F.regexp_replace(masked, r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", " "))


def split_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, doc_id, chunk_no, line_no, key hash) of every non-blank line.

    ``chunks``: chunk_no, doc_id, text; ``documents``: doc_id, host.  Rows
    delivered twice count once.  Chunks without text, and chunks of documents
    without host or without a row, have no source and so no cases.
    """
    hosts = documents.where("doc_id IS NOT NULL AND trim(host) != ''").select("doc_id", F.lower(F.trim("host")).alias("source")).distinct()
    lines = (
        chunks.where("text IS NOT NULL AND doc_id IS NOT NULL")
        .select("chunk_no", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("chunk_no", "doc_id", (F.col("line_no") + 1).cast("int").alias("line_no"), line_key(F.col("line")).alias("key"))
        .where("key != ''")
        .select("chunk_no", "doc_id", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    return lines.join(hosts, "doc_id")


def _cell(width: str) -> Column:
    return F.col("h1").bitwiseAND(F.col(width) - 1)


def summaries(lines: DataFrame) -> DataFrame:
    """The mergeable summary of each source: (source, width, cell, n)."""
    sizes = lines.groupBy("source").agg(F.count("*").alias("total"))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(16.0), F.col("total") * WIDTH_SHARE)))).cast("long")
    sizes = stage(sizes.select("source", width.alias("width")))
    keyed = join_small(lines.select("source", "h1"), sizes, ["source"])
    return keyed.groupBy("source", "width", _cell("width").alias("cell")).agg(F.count("*").alias("n"))


def merged(parts: DataFrame) -> DataFrame:
    """Summaries of several partitions or days, one below the other, as one: a
    source has the width of its narrowest part."""
    narrow = stage(parts.groupBy("source").agg(F.min("width").alias("to")))
    folded = join_small(parts, narrow, ["source"])
    return folded.groupBy("source", F.col("to").alias("width"), F.col("cell").bitwiseAND(F.col("to") - 1).alias("cell")).agg(F.sum("n").alias("n"))


def repeated_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, summary: DataFrame | None = None) -> DataFrame:
    """(source, h1, h2) of the lines in at least ``min_documents`` documents.
    ``summary``: that of the lines, if it is there, as ``merged`` gives it.

    A third of all rows in one source, or one line in all its documents, is
    spread over many tasks: counters are keyed by source and cell, and distinct
    documents are made by (source, line, document) before they are counted.
    """
    heavy = stage((summaries(lines) if summary is None else summary).where(F.col("n") >= min_documents).select("source", "width", "cell"))
    widths = stage(heavy.select("source", "width").distinct())
    candidates = join_small(lines.select("source", "h1", "h2", "doc_id"), widths, ["source"])
    candidates = candidates.withColumn("cell", _cell("width"))
    candidates = join_small(candidates, heavy, ["source", "width", "cell"], "left_semi")
    documents = candidates.groupBy("source", "h1", "h2", "doc_id").agg(F.lit(1).alias("_"))
    return documents.groupBy("source", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("source", "h1", "h2")


def found_lines(chunks: DataFrame, documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Distinct (chunk_no, line_no) of all excessively repeated lines.

    Empty tables give no rows; null texts, blank lines and unknown sources are
    no cases; columns besides those named are ignored.
    """
    lines = stage(split_lines(chunks, documents))
    confirmed = stage(repeated_lines(lines, min_documents))
    hits = join_small(lines, confirmed, ["source", "h1", "h2"], "left_semi")
    return hits.select("chunk_no", "line_no").distinct()


def clean_chunks(chunks: DataFrame, documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(chunk_no, removed_lines, text) of each chunk without those lines.

    A chunk delivered twice comes out once; of different texts under one
    chunk_no the greatest holds.  A null text stays null.
    """
    once = chunks.groupBy("chunk_no").agg(F.max(F.struct("text", "doc_id")).alias("c")).select("chunk_no", "c.text", "c.doc_id")
    found = found_lines(once, documents, min_documents).groupBy("chunk_no").agg(F.collect_list("line_no").alias("drop"))
    joined = once.join(found, "chunk_no", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("drop"), (i + 1).cast("int")))
    return joined.select("chunk_no", F.size("drop").alias("removed_lines"), F.array_join(kept, "\n").alias("text"))

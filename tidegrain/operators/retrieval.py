"""Retrieval from the document memory: vectors, topics, paths, hosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import urls
from tidegrain.functions.text import one_line
from tidegrain.functions.values import first_filled, given, piped_id, recency
from tidegrain.functions.vectors import DIMENSIONS
from tidegrain.runtime import join_small, stage

#: Query vectors that are compared with all rows at once; 8 bytes a component.
QUERY_BLOCK = 2_048
#: Rows that a block of queries meets at once in a worker.
ROW_BLOCK = 2_048


def fit_vectors(rows: DataFrame, vector: str = "vector", dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows whose vector has the right dimension, is finite and not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size(vector) == dimensions) & ~odd & F.exists(vector, lambda x: x != 0))


def _scan(sent, k: int, weight: float, positive: bool):  # noqa: ANN001, ANN202, FBT001
    """The k best rows of this partition for each query vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = sent.value
        best_score, best_sim = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0.0)
        best_id = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for start in range(0, len(batch), ROW_BLOCK):
                part = batch.iloc[start : start + ROW_BLOCK]
                rows = np.stack(part["vector"].to_numpy()).astype(np.float64)
                rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                sim = np.round(queries @ rows.T, 9)
                score = np.round(sim * weight + part["bonus"].to_numpy(), 9)
                if positive:
                    score[sim <= 0] = -np.inf
                scores, sims = np.concatenate([best_score, score], axis=1), np.concatenate([best_sim, sim], axis=1)
                own = np.concatenate([best_id, np.broadcast_to(part["vec_id"].to_numpy(), (len(ids), len(rows)))], axis=1)
                order = np.lexsort((own, -scores), axis=1)[:, :k]
                best_score, best_sim, best_id = (np.take_along_axis(x, order, axis=1) for x in (scores, sims, own))
        if best_sim.size:
            found = pd.DataFrame({"query_id": np.repeat(ids, best_sim.shape[1]), "vec_id": best_id.ravel(), "similarity": best_sim.ravel(), "score": best_score.ravel()})
            yield found[np.isfinite(found["score"])]

    return run


def best_scored(queries: DataFrame, rows: DataFrame, k: int, weight: float = 1.0, block: int = QUERY_BLOCK, positive: bool = False) -> DataFrame:  # noqa: FBT001, FBT002
    """(query_id, vec_id, similarity, score, rank) of the k rows of each query
    with the highest ``weight`` * exact cosine + the row's own ``bonus``; ties,
    to 9 decimals, to the smaller vec_id.  ``positive``: only rows with a cosine
    above 0.

    A stated set of query vectors meets all rows in blocks: each block of
    queries is sent to the rows, which are read in place and not shuffled; k
    rows per query and partition are all that moves.
    """
    fit = fit_vectors(rows).select("vec_id", "vector", F.col("bonus").cast("double").alias("bonus"))
    asked = stage(fit_vectors(queries.withColumnRenamed("query_vector", "vector")).select("query_id", "vector"))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toPandas()  # one block
        vectors = np.stack(part["vector"].to_numpy()).astype(np.float64) if len(part) else np.zeros((0, DIMENSIONS))
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        sent = rows.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(np.int64), vectors))
        found = fit.mapInPandas(_scan(sent, k, weight, positive), "query_id long, vec_id long, similarity double, score double")
        out = found if out is None else out.unionAll(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def most_similar(queries: DataFrame, rows: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, similarity) of the k most similar rows of each query,
    by exact cosine; ties, to 9 decimals, to the smaller vec_id."""
    return best_scored(queries, rows.withColumn("bonus", F.lit(0.0)), k, block=block).drop("score")


def document_score(similarity: Column, as_of: Column, hinted: Column | None = None, proved: Column | None = None) -> Column:
    """How well a remembered document meets a query."""
    score = similarity * 3 + recency(F.col("observed_at"), as_of) + given(F.col("stable_ratio") > 0, 1.0) * F.coalesce(F.nanvl("stable_ratio", F.lit(0.0)), F.lit(0.0)) * 0.08
    score = score + F.coalesce(F.nanvl("novelty_ratio", F.lit(0.0)), F.lit(0.0)) * 0.08 + given(F.coalesce("changed_recently", F.lit(False)), 0.06)
    score = score if proved is None else score + given(proved, 0.08)
    return score if hinted is None else score + given(hinted, 0.2)


def topic_score(similarity: Column, as_of: Column) -> Column:
    """How well a topic node meets a query."""
    support = F.least(F.greatest(F.col("support_count") - 1, F.lit(0)), F.lit(4)) * 0.18 + F.least("child_count", F.lit(3)) * 0.12
    return similarity * 3.15 + support + F.when(F.col("topic_depth") > 0, 0.42 / (F.col("topic_depth") + 1)).otherwise(0.0) + recency(F.col("observed_at"), as_of)


def with_ancestors(documents: DataFrame, least_depth: int = 1) -> DataFrame:
    """A row per document and path at or above its own; this turns a join on
    path prefixes into one on equal paths."""
    roots = F.filter(urls.ancestors(F.col("path")), lambda p: F.size(urls.parts(p)) >= least_depth)
    return documents.withColumn("root_path", F.explode(roots))


def topics(documents: DataFrame) -> DataFrame:
    """One row per host and path of depth 2 or more with the documents below
    it: representative, support, children, latest observation, mean vector.

    ``documents``: host, path, url, title, summary, observed_at, vector.  The
    representative has the shortest path, then the latest time.  It weighs
    1.75 in the mean, documents as deep as it .25 more.  All documents of a
    site meet in partial sums, none in one task.
    """
    rows = with_ancestors(documents.where("host IS NOT NULL AND path IS NOT NULL"), 2)
    order = F.struct(F.length("path").alias("l"), (-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("t"), "url", "title", "path")
    heads = rows.groupBy("host", "root_path").agg(F.min(order).alias("first"), F.count("*").alias("support_count"), F.max("observed_at").alias("observed_at"))
    heads = stage(heads)
    weighed = join_small(rows.select("host", "root_path", "url", "path", "vector"), heads.select("host", "root_path", F.col("first.url").alias("rep"), urls.depth(F.col("first.path")).alias("rep_depth")), ["host", "root_path"])
    weight = F.when(F.col("url") == F.col("rep"), 1.75).otherwise(1.0) + given(urls.depth(F.col("path")) == F.col("rep_depth"), 0.25)
    terms = weighed.select("host", "root_path", weight.alias("w"), F.posexplode("vector").alias("i", "x"))
    mean = (F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m")
    vectors = terms.groupBy("host", "root_path", "i").agg(mean).groupBy("host", "root_path").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))  # as long as a vector
    joined = heads.join(vectors, ["host", "root_path"], "left")
    return joined.select(
        F.concat_ws("|", F.lower(F.trim("host")), "root_path").alias("topic_key"), "host", "root_path", F.col("first.url").alias("representative_url"), F.col("first.title").alias("representative_title"), "support_count",
        (F.col("support_count") - 1).alias("child_count"), urls.depth(F.col("root_path")).alias("topic_depth"), "observed_at", F.transform("v", lambda x: x["m"]).alias("vector"),
    )


def topic_summaries(documents: DataFrame, size: int = 800) -> DataFrame:
    """(host, root_path, summary): titles and summaries of the first four
    documents of each topic, each once, ``size`` characters at most."""
    rows = with_ancestors(documents.where("host IS NOT NULL AND path IS NOT NULL"), 2)
    order = Window.partitionBy("host", "root_path").orderBy(F.length("path"), F.desc("observed_at"), "url")
    few = rows.withColumn("rn", F.row_number().over(order)).where("rn <= 4")
    said = few.groupBy("host", "root_path").agg(F.array_sort(F.collect_list(F.struct("rn", "title", "summary"))).alias("s"))
    pieces = F.flatten(F.transform("s", lambda x: F.array(first_filled(x["title"], x["summary"]), F.trim(x["summary"]))))
    joined = F.array_join(F.array_distinct(F.filter(pieces, lambda x: F.coalesce(x, F.lit("")) != "")), " ")
    return said.select("host", "root_path", first_filled(F.trim(F.substring(one_line(joined), 1, size)), F.col("root_path")).alias("summary"))


def ancestor_roots(hits: DataFrame, documents: DataFrame, as_of: Column, limit: int, inclusive: bool = False, proved: Column | None = None) -> DataFrame:  # noqa: FBT001, FBT002
    """Remembered pages above the hits with two documents or more below them.

    ``hits``: query_id, host, path.  Scored by support, recency and ratios, and
    by proof if ``proved`` is given.  ``inclusive``: also the hits themselves.
    """
    above = hits.withColumn("path_depth", urls.depth(F.col("path")))
    above = above.select("query_id", "host", F.explode(urls.ancestors(F.col("path"))).alias("root_path"), "path_depth").where(F.lit(inclusive) | (urls.depth(F.col("root_path")) < F.col("path_depth")))
    wanted = above.select("query_id", "host", "root_path").distinct()
    support = with_ancestors(documents).groupBy("host", "root_path").agg(F.count_distinct("url").alias("support")).where("support >= 2")
    roots = wanted.join(support, ["host", "root_path"]).join(documents.withColumnRenamed("path", "root_path"), ["host", "root_path"])
    ratio = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) * 0.05
    score = F.lit(1.4) + F.least((F.col("support") - 1) * 0.32, F.lit(0.9)) + recency(F.col("observed_at"), as_of) + ratio("stable_ratio") + ratio("novelty_ratio")
    score = score if proved is None else score + given(proved, 0.06)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    return roots.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "url", "support", "score", "rank")


def neighbours(hits: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Pages that the hits link to: of the same host first, then the latest.

    ``hits``: query_id, url; ``edges``: url, target, same_host, observed_at.
    """
    order = Window.partitionBy("query_id", "url").orderBy(F.desc("same_host"), F.desc("observed_at"), "target")
    linked = hits.join(edges, "url").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return linked.select("query_id", "url", "target", "rank", (F.lit(0.7) + given(F.col("same_host"), 0.2)).alias("score"))


def host_pages(documents: DataFrame, limit: int) -> DataFrame:
    """The latest pages of each host, short paths first."""
    order = Window.partitionBy("host").orderBy(F.desc("observed_at"), F.length("path"), "url")
    return documents.where("host IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def host_score(as_of: Column, proved: Column) -> Column:
    """How well a remembered document meets a query that its host meets."""
    ratio = lambda c: F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) * 0.05
    return F.lit(0.78) + recency(F.col("observed_at"), as_of) + ratio("stable_ratio") + ratio("novelty_ratio") + given(proved, 0.06)


def embedding_ref(url: Column, text: Column, model: str) -> Column:
    return piped_id("emb", url, F.lit(model), F.sha2(F.coalesce(text, F.lit("")), 256))

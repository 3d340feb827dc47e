"""The commands of the engine over tables: read, query, crawl, memory, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import text as T
from tidegrain.functions import urls
from tidegrain.functions.vectors import cosine, embed
from tidegrain.operators import analytics, discovery, graphs, keyed, packets, pages, retrieval
from tidegrain.sources.settings import Settings


def read(page_rows: DataFrame, profile: str = "standard", objective: str | None = None) -> DataFrame:
    """One packet per page (page_no, url, html).  An objective raises segments
    that are like it by the hash embedder."""
    alignment = None
    if objective is not None:
        goal = embed(F.lit(objective))
        alignment = cosine(embed(F.col("text")), goal)
    return packets.packets(page_rows, profile, alignment)


def discover(page_rows: DataFrame, goals: DataFrame, limit: int = 5) -> DataFrame:
    """The best links of each seed page for its goal.

    ``goals``: query_id, goal, seed_url.  Candidates are the seed and the links
    of its page, scored by address and by how like their labels are to the goal.
    """
    links = pages.page_links(page_rows, same_host=True).select("url", F.col("target").alias("candidate"), "label")
    seeds = page_rows.select("url", F.col("url").alias("candidate"), F.lit("").alias("label")).distinct()
    asked = goals.select("query_id", "goal", F.col("seed_url").alias("url"))
    rows = links.unionByName(seeds).join(asked, "url")
    words = F.concat_ws(" ", "label", urls.token_text(F.col("candidate")))
    score = discovery.candidate_score(F.col("candidate")) + 3 * cosine(embed(F.lower(words)), embed(F.lower("goal")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate")
    best = rows.groupBy("query_id", "candidate", "goal").agg(F.max("label").alias("label")).withColumn("score", score)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", F.col("candidate").alias("url"), "label", F.round("score", 6).alias("score"), "rank")


def query(page_rows: DataFrame, goals: DataFrame, profile: str = "standard") -> DataFrame:
    """The packet of the best known page for each goal.

    The page chosen is the best candidate that is among the pages; the packet
    is that of ``read``.
    """
    found = discover(page_rows, goals, limit=50).join(page_rows.select("url", "page_no").distinct(), "url")
    order = Window.partitionBy("query_id").orderBy("rank", "page_no")
    chosen = found.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("query_id", "page_no", "score")
    needed = page_rows.join(chosen.select("page_no").distinct(), "page_no", "left_semi")
    return chosen.join(read(needed, profile), "page_no")


def crawl(page_rows: DataFrame, seeds: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(seed, url, depth) of the known pages reached from each seed by links of
    its own site, max_depth steps and max_pages pages a seed at most."""
    limits = settings or Settings()
    known = page_rows.select("url").distinct()
    links = pages.page_links(page_rows, same_host=True).select("url", "target").distinct()
    seen = seeds.select("seed", F.col("seed").alias("url"), F.lit(0).alias("depth")).join(known, "url", "left_semi")
    front = seen
    for step in range(1, limits.max_depth + 1):
        found = front.join(links, "url").select("seed", F.col("target").alias("url")).distinct().join(known, "url", "left_semi")
        front = found.join(seen, ["seed", "url"], "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(front)
    order = Window.partitionBy("seed").orderBy("depth", "url")
    return seen.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limits.max_pages).drop("rn")


def proof(packet_rows: DataFrame, wanted: str) -> DataFrame:
    """The proof with an id, or that of the chunk with it."""
    each = packet_rows.select("page_no", "url", F.explode("chunks").alias("c"))
    return each.where((F.col("c.proof.proof_id") == wanted) | (F.col("c.chunk_id") == wanted)).select("page_no", "url", "c.chunk_id", "c.proof.*")


def replay(runs: DataFrame) -> DataFrame:
    """Per trace: runs, stages seen and whether all succeeded."""
    return runs.groupBy("trace_id").agg(F.count("*").alias("runs"), F.array_sort(F.collect_set("operation")).alias("stages"), F.bool_and("success").alias("deterministic"))


def diff(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """added, removed and changed rows of two tables by key."""
    return keyed.changed_values(a, b, key, value)


def align(objective: DataFrame, candidates: DataFrame, least: float = 0.55, lead: float = 0.08) -> DataFrame:
    """Per query the most similar candidate, the lead over the next, and whether
    it stands out enough to need no further look.

    ``objective``: query_id, text; ``candidates``: query_id, id, text.
    """
    asked = objective.select("query_id", embed(F.lower("text")).alias("goal"))
    scored = candidates.join(asked, "query_id").withColumn("similarity", cosine(embed(F.lower("text")), F.col("goal")))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    two = scored.withColumn("rn", F.row_number().over(order)).where("rn <= 2").groupBy("query_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("rn") == 1, F.col("similarity"))).alias("top"), F.max(F.when(F.col("rn") == 2, F.col("similarity"))).alias("second"),
    )
    return two.select("query_id", "id", "top", "second", ((F.col("top") >= least) & (F.col("top") - F.coalesce("second", F.lit(0.0)) >= lead)).alias("stands_out"))


def observe(packet_rows: DataFrame, at: Column) -> DataFrame:
    """Memory rows of packets: summary of the first three chunks, vector and its
    reference."""
    heads = F.array_join(F.transform(F.slice("chunks", 1, 3), lambda c: c["text"]), " ")
    summary = T.head(heads, 600)
    rows = packet_rows.select("url", "title", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), summary.alias("summary"), at.alias("observed_at"))
    return rows.select("*", embed(F.lower("summary")).alias("vector"), retrieval.embedding_ref(F.col("url"), F.col("summary"), "hash64").alias("embedding_ref"))


def remember(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Memory rows with new ones put over them by address."""
    return keyed.upsert(memory, new, ["url"], ["observed_at"])


def prune(rows: DataFrame, at: str, before: Column) -> DataFrame:
    return keyed.pruned(rows, at, before)


#: The commands on run facts and graphs under their own names.
stats, value_report, rollup, expand_hosts = analytics.stats, analytics.value_report, analytics.rollup, graphs.expanded

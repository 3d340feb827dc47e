"""Scores of candidate addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions import urls
from tidegrain.functions.values import findings, given
from tidegrain.functions.vectors import cosine, embed


def candidate_score(url: Column, hints: Column | None = None) -> Column:
    """The score of an address by its form, class, host and hints."""
    host = urls.host(url)
    base = F.lit(0.35) + urls.structure_boost(url) + urls.resource_boost(urls.resource_class(urls.path(url))) + urls.compactness(host)
    return base if hints is None else base + given(F.array_contains(hints, host), 1.10)


def candidate_reasons(url: Column) -> Column:
    """What speaks for or against an address."""
    form, kind = urls.structure_boost(url), urls.resource_boost(urls.resource_class(urls.path(url)))
    return findings(
        (F.lit(True), "seed_fallback"), (form > 0, "structure_hint"), (form < 0, "structure_penalty"), (kind > 0, "resource_class_hint"), (kind < 0, "resource_class_penalty"), (urls.compactness(urls.host(url)) > 0, "host_compactness"),
    )


def shallow_preferred(candidates: DataFrame) -> DataFrame:
    """url, host, family, depth, score with the boost of candidates that are
    shallower than others of their family within .35 of their score.

    Scores before any boost are compared.  Candidates are first counted by
    (depth, score): scores are sums of fixed amounts, so a family has few such
    steps however many candidates it has, and only steps meet each other.
    """

    def deeper(group: str) -> DataFrame:
        steps = candidates.groupBy(group, "depth", "score").agg(F.count("*").alias("n"))
        others = steps.select(group, F.col("depth").alias("depth2"), F.col("score").alias("score2"), F.col("n").alias("more"))
        within = steps.drop("n").join(others, group).where("depth < depth2 AND score2 - score <= 0.35")
        return within.groupBy(group, "depth", "score").agg(F.sum("more").alias(f"deeper_{group}"))

    joined = candidates.join(deeper("family"), ["family", "depth", "score"], "left").join(deeper("host"), ["host", "depth", "score"], "left")
    of = lambda c: F.coalesce(c, F.lit(0))
    boost = of("deeper_family") * F.when(F.col("depth") == 0, 0.18).otherwise(0.12) + F.when(F.col("depth") == 0, of("deeper_host") * 0.10).otherwise(0.0)
    return joined.withColumn("boosted", F.col("score") + boost).drop("deeper_family", "deeper_host")


def first_per_family(candidates: DataFrame, limit: int) -> DataFrame:
    """The best candidate of each family, the best ``limit`` of them."""
    best = candidates.withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("score"), "url"))).where("rn = 1").drop("rn")
    return best.orderBy(F.desc("score"), "url").limit(limit)


def evidence_reranked(candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """Score less .20 for pages that are stable and unchanged, and .20 more for
    new or changed ones.  ``latest``: url, stable_ratio, novelty_ratio,
    changed_recently."""
    joined = candidates.join(latest, "url", "left")
    stable = (F.col("stable_ratio") >= 0.80) & ~F.coalesce("changed_recently", F.lit(False)) & ~F.isnan("stable_ratio")
    fresh = ((F.col("novelty_ratio") > 0.20) & ~F.isnan("novelty_ratio")) | F.coalesce("changed_recently", F.lit(False))
    return joined.withColumn("reranked", F.col("score") + F.when(F.coalesce(stable, F.lit(False)), -0.20).when(F.coalesce(fresh, F.lit(False)), 0.20).otherwise(0.0))


def margins(candidates: DataFrame, group: str) -> DataFrame:
    """Per group: leader, its lead over the next, and whether to ask again."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "url")
    two = candidates.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    best = two.groupBy(group).agg(F.max(F.when(F.col("rn") == 1, F.col("url"))).alias("leader"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"))
    margin = F.col("top") - F.coalesce("second", F.lit(0.0))
    return best.select(group, "leader", F.round(margin, 6).alias("margin"), (margin <= 0.25).alias("ambiguous"))


def disambiguated(candidates: DataFrame, goals: DataFrame) -> DataFrame:
    """Candidates of each query with .90 of how like its goal their family is,
    where two families or more are left and the best two candidates are within
    .25 of each other.

    ``candidates``: query_id, url, label, score; ``goals``: query_id, goal.  The
    text of a family is that of its first three candidates: label, words of the
    host and the family.  Queries with a blank goal keep their scores.
    """
    own = candidates.withColumn("family", F.coalesce(urls.family(urls.host(F.col("url"))), F.trim("url")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    within = Window.partitionBy("query_id", "family").orderBy(F.desc("score"), "url")
    placed = own.withColumn("place", F.row_number().over(order)).withColumn("member", F.row_number().over(within))
    words = F.concat_ws(" ", "label", F.translate(urls.host(F.col("url")), ".-", "  "), "family")
    texts = placed.where("member <= 3").groupBy("query_id", "family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", words.alias("text")))), lambda x: x["text"]), " ").alias("text"))
    state = placed.groupBy("query_id").agg(F.count_distinct("family").alias("families"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    open_ = state.where("families >= 2 AND top - second <= 0.25").join(goals.where("trim(goal) != ''").select("query_id", "goal"), "query_id").select("query_id", "goal")
    alike = texts.join(open_, "query_id").select("query_id", "family", F.greatest(cosine(embed(F.lower("text")), embed(F.lower("goal"))), F.lit(0.0)).alias("alike"))
    joined = own.join(alike, ["query_id", "family"], "left")
    return joined.select(*candidates.columns, "family", (F.col("score") + 0.90 * F.coalesce("alike", F.lit(0.0))).alias("disambiguated"))


def literal_candidates(texts: DataFrame) -> DataFrame:
    """Addresses that stand in the texts of a page: (page_no, source, url,
    score, rank), two a page at most.

    ``texts``: page_no, url, pos, text.  Of the first four distinct addresses of
    the page's own family; media assets of HTML pages are left out.  Scored as
    candidates with 1.10 more, and .12 for paths of three parts or more.
    """
    found = texts.select("page_no", F.col("url").alias("source"), "pos", F.posexplode(F.regexp_extract_all("text", F.lit(r"https?://[^\s\"'<>()]+"), F.lit(0))).alias("nth", "url"))
    found = found.withColumn("url", F.regexp_replace("url", r"[.,;:!?]+$", ""))
    family = lambda c: urls.family(urls.host(F.col(c)))
    same = found.where((family("url") == family("source")) & (F.col("url") != "")).groupBy("page_no", "source", "url").agg(F.min(F.struct("pos", "nth")).alias("at"))
    first = same.withColumn("seen", F.row_number().over(Window.partitionBy("page_no").orderBy("at", "url"))).where("seen <= 4")
    kind = lambda c: urls.resource_class(urls.path(F.col(c)))
    kept = first.where(~((kind("source") == "html_like") & (kind("url") == "media_asset")))
    score = candidate_score(F.col("url")) + 1.10 + given(urls.depth(urls.path(F.col("url"))) >= 3, 0.12)
    ranked = kept.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("page_no").orderBy(F.desc("score"), "url")))
    return ranked.where("rank <= 2").select("page_no", "source", "url", "score", "rank")


def merged(found: DataFrame) -> DataFrame:
    """What providers found, each address of a query once: the best score, its
    label, and who found it.  ``found``: query_id, provider, url, label, score."""
    best = F.max(F.struct("score", "label")).alias("b")
    return found.where("trim(url) != ''").groupBy("query_id", "url").agg(best, F.array_sort(F.collect_set("provider")).alias("providers")).select("query_id", "url", "b.label", "b.score", "providers")


def web_discovery(found: DataFrame, goals: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, rank, url, label, providers, score): the best ``limit`` of all
    that providers found for all queries of a goal.

    Merged by address, reranked by how like the goal label and address are,
    shallower ones of a family preferred, one a family, then disambiguated.
    """
    once = merged(found).join(goals.select("query_id", "goal"), "query_id")
    text = F.lower(F.concat_ws(" ", "label", urls.token_text(F.col("url"))))
    scored = once.withColumn("score", F.col("score") + 3 * F.greatest(cosine(embed(text), embed(F.lower("goal"))), F.lit(0.0)) + F.when(urls.depth(urls.path(F.col("url"))) == 0, 0.18).otherwise(0.0))
    family = F.coalesce(urls.family(urls.host(F.col("url"))), F.trim("url"))
    first = scored.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", family).orderBy(F.desc("score"), "url"))).where("rn = 1")
    few = first.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "url"))).where(F.col("rn") <= limit)
    asked = disambiguated(few.select("query_id", "url", "label", "score", "providers"), goals)
    order = Window.partitionBy("query_id").orderBy(F.desc("disambiguated"), "url")
    return asked.select("query_id", F.row_number().over(order).alias("rank"), "url", "label", "providers", F.round("disambiguated", 6).alias("score"))

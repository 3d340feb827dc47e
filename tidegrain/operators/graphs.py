"""Graphs of hosts and pages as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.runtime import Staged, join_small, stage


def transitions(visits: DataFrame, key: str, order: list[str], place: str) -> DataFrame:
    """(from_place, to_place, count, last_seen): from each visit of a key to its next
    one at another place; visits without a key or place are left out.

    The next visit is looked for in the same hour first and then in the key's
    next hour with visits, so a key with a large part of all visits is spread
    over its hours.  ``order`` begins with the time.
    """
    kept = visits.where(F.col(key).isNotNull() & (F.trim(place) != "")).withColumn("_slot", F.date_trunc("hour", F.col(order[0]).cast("timestamp")))
    after = F.lead(F.struct(place)).over(Window.partitionBy(key, "_slot").orderBy(*order))
    local = kept.select(key, "_slot", F.col(place).alias("from_place"), F.col(order[0]).alias("at"), after.alias("next"))
    firsts = kept.groupBy(key, "_slot").agg(F.min(F.struct(*order, place))[place].alias("first"))
    hours = firsts.select(F.col(key).alias("_key"), F.col("_slot").alias("_hour"), F.lead("first").over(Window.partitionBy(key).orderBy("_slot")).alias("later"))  # one row per key and hour
    joined = local.join(hours, (F.col(key) == F.col("_key")) & F.col("_slot").eqNullSafe(F.col("_hour")))
    steps = joined.select("from_place", F.coalesce(F.col(f"next.{place}"), "later").alias("to_place"), "at")
    return steps.where("to_place IS NOT NULL AND from_place != to_place").groupBy("from_place", "to_place").agg(F.count("*").alias("count"), F.max("at").alias("last_seen"))


def expanded(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Places next to the seeds: an outbound count in full, an inbound one by
    half; seeds themselves are left out.  ``seeds``: place."""
    seeds = stage(seeds.select("place").distinct())
    n = seeds.count()
    out = join_small(edges.where("count > 0").withColumnRenamed("from_place", "place"), seeds, ["place"], "left_semi", n).select(F.col("to_place").alias("place"), F.col("count").cast("double").alias("score"), F.lit("outbound_transition").alias("reason"))
    into = join_small(edges.where("count > 0").withColumnRenamed("to_place", "place"), seeds, ["place"], "left_semi", n).select(F.col("from_place").alias("place"), (F.col("count") * 0.5).alias("score"), F.lit("inbound_transition").alias("reason"))
    summed = join_small(out.unionAll(into), seeds, ["place"], "left_anti", n).groupBy("place").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return summed.orderBy(F.desc("score"), "place").limit(limit)


def reached(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(place, depth) of what is reached from the seeds in at most so many
    steps, with the least number; one join per step."""
    links = stage(edges.select(F.col("from_place").alias("place"), "to_place").distinct())
    seen = stage(seeds.select("place").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for step in range(1, depth + 1):
        found = links.join(front.select("place"), "place").select(F.col("to_place").alias("place")).distinct()
        front = stage(found.join(seen, "place", "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = stage(seen.unionAll(front))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph; a component is named by its
    least node.

    Each round links every node to the least label next to it and then lets
    labels take over the labels of their labels, so that the number of rounds
    follows the logarithm of the longest path.  Labels never leave the tables.
    ``edges``: a, b; loops and repeated edges don't matter.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    links = stage(both)
    labels = Staged(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = links.join(labels.df.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.df.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", F.coalesce("least", "label")).alias("next"), "label")
        jump = labels.df.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        after = Staged(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), (F.least("next", F.coalesce("jump", "next")) != F.col("label")).alias("moved")))
        moved = not after.df.where("moved").isEmpty()
        labels.drop()
        labels = after
        if not moved:
            return labels.df.select("node", F.col("label").alias("component"))

"""Choices among ranked rows and candidates that depend on one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions.values import findings
from tidegrain.runtime import columns_of, map_groups


def stable_gate(ranked: DataFrame, group: str, limit: int) -> DataFrame:
    """The first ``limit`` by rank; if none of them is stable, the last one gives
    way to the best stable row of the group.  Needs ``rank`` and ``stable``."""
    by = Window.partitionBy(group)
    inside = F.col("rank") <= limit
    has = F.max(F.when(inside & F.col("stable"), 1)).over(by)
    best = F.min(F.when(~inside & F.col("stable"), F.col("rank"))).over(by)
    marked = ranked.withColumn("_has", has).withColumn("_best", best)
    swap = F.col("_has").isNull() & F.col("_best").isNotNull()
    kept = F.when(swap, (F.col("rank") < limit) | (F.col("rank") == F.col("_best"))).otherwise(inside)
    return marked.where(kept).drop("_has", "_best")


def partly_reused(ranked: DataFrame, group: str, limit: int) -> DataFrame:
    """The selection of each group with half of it taken over in the order in
    which it was stable, if two thirds of it are stable; then filled up by rank.

    Needs ``rank``, ``stable`` and ``stable_order``; gives ``place``.  One page's
    rows at a time.
    """

    def run(page: list[dict]) -> list[dict]:
        rows = sorted(page, key=lambda r: r["rank"])
        chosen = rows[:limit]
        known = [r for r in chosen if r["stable"]]
        if chosen and 3 * len(known) >= 2 * len(chosen):
            first = sorted(known, key=lambda r: (r["stable_order"], r["rank"]))[: len(chosen) // 2]
            taken = {r["rank"] for r in first}
            chosen = (first + [r for r in rows if r["rank"] not in taken])[: len(chosen)]
        return [r | {"place": i + 1} for i, r in enumerate(chosen)]

    return map_groups(ranked, group, run, f"{columns_of(ranked)}, place int")


def _contained(a: str, b: str) -> float:
    """The share of the longer text that the shorter one covers within it."""
    short, long = sorted((a, b), key=len)
    return len(short) / len(long) if short and short in long else 0.0


def _common_start(a: str, b: str) -> float:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return n / min(len(a), len(b)) if a and b else 0.0


def compacted(chunks: DataFrame, group: str, limit: int = 5) -> DataFrame:
    """Up to ``limit`` rows of each group that are worth showing.

    A row is left out if it repeats one before it (equal, contained to .82, or
    the same start to .74 under the same heading path), or if it is of little
    use (utility under .42) after one of .68 or more.  Greedy by rank, one
    page's rows at a time.  Needs ``rank``, ``text``, ``heading_path``,
    ``utility``.
    """

    def run(page: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for row in sorted(page, key=lambda r: r["rank"]):
            text = " ".join((row["text"] or "").split())
            path = list(row["heading_path"]) if row["heading_path"] is not None else []
            again = any(text == t or _contained(text, t) >= 0.82 or (path == p and _common_start(text, t) >= 0.74) for t, p in ((k["_t"], k["_p"]) for k in kept))
            weak = row["utility"] < 0.42 and any(k["utility"] >= 0.68 for k in kept)
            if text and not again and not weak:
                kept.append(row | {"_t": text, "_p": path})
            if len(kept) == limit:
                break
        return kept

    return map_groups(chunks, group, run, columns_of(chunks))


def patched(selections: DataFrame, patches: DataFrame, least: float = 0.78) -> DataFrame:
    """The selections after typed patches: one is applied if it parses, chooses
    at least one and only known candidates, and is sure enough.

    ``selections``: id, candidates, selected; ``patches``: id, body (JSON).
    Gives ``selected`` and ``outcome``.
    """
    read = F.from_json("body", "struct<selected: array<string>, confidence: double>")
    joined = selections.join(patches.select("id", read.alias("p")), "id", "left")
    chosen = F.col("p.selected")
    outcome = (
        F.when(F.col("p").isNull(), "none").when(chosen.isNull() | (F.size(chosen) == 0), "empty").when(F.size(F.array_except(chosen, "candidates")) > 0, "unknown_candidate")
        .when(~F.coalesce(F.col("p.confidence") >= least, F.lit(False)), "unsure").otherwise("applied")
    )
    return joined.select("id", F.when(outcome == "applied", chosen).otherwise(F.col("selected")).alias("selected"), outcome.alias("outcome"))


def regressions(before: DataFrame, after: DataFrame, key: list[str], slower: float = 1.2) -> DataFrame:
    """Rows of two reports by name, with what became worse.

    Both: key, runs, passed (share), latency.
    """
    a = before.select(*key, F.col("passed").alias("old_passed"), F.col("latency").alias("old_latency"))
    b = after.select(*key, "passed", "latency")
    worse = findings((F.col("passed") < F.col("old_passed"), "pass_rate"), (F.col("latency") > F.col("old_latency") * slower, "latency"))
    return a.join(b, key).select(*key, "old_passed", "passed", "old_latency", "latency", worse.alias("worse"))


def decisions(runs: DataFrame) -> DataFrame:
    """The decisions behind each run as (stage, choice, reason) in order, and
    the required stages that are missing."""
    one = lambda stage, choice, reason: F.struct(F.lit(stage).alias("stage"), choice.alias("choice"), reason.alias("reason"))
    lead = F.col("candidate_count")
    made = F.array(
        one("mode", F.coalesce("discovery_mode", F.lit("off")), F.when(F.col("seed_present"), "seed_given").otherwise("no_seed")),
        one("budget", F.coalesce("profile", F.lit("standard")), F.when(F.col("profile") == "tiny", "latency_constrained").otherwise("default")),
        one("memory", F.when(F.col("local_memory_used"), "used").otherwise("unused"), F.when(F.col("topic_node_used"), "topic_node").otherwise("none")),
        one("discovery", F.coalesce("provider", F.lit("none")), F.when(lead <= 1, "low_candidate_set").otherwise("candidates")),
        one("selection", F.when(F.col("selected_url").isNotNull(), "selected").otherwise("none"), F.when(F.col("same_site_recovery_used"), "recovered").otherwise("first")),
    )
    return runs.select("run_id", made.alias("decisions"), F.array_except(F.array(*(F.lit(x) for x in ("mode", "budget", "memory", "discovery", "selection"))), F.transform(F.filter(made, lambda d: d["choice"] != "none"), lambda d: d["stage"])).alias("missing"))


def digest(rows: DataFrame, name: str) -> DataFrame:
    """One row: the rows of a table and a hash that doesn't depend on their order."""
    own = F.xxhash64(*(F.coalesce(F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string"), F.lit("")) for c, kind in rows.dtypes))
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(own.cast("decimal(20,0)")).cast("string").alias("digest"))


def normalized_rewrites(text: Column, limit: int = 3) -> Column:
    """Up to ``limit`` distinct queries of a list, blanks made single."""
    plain = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    return F.slice(F.array_distinct(plain), 1, limit)

"""Run facts and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions.values import ratio
from tidegrain.runtime import join_small, stage


def saved(raw: str = "raw_fetch_chars", kept: str = "final_context_chars") -> Column:
    """Characters that were fetched and not handed on, 0 at least."""
    return F.greatest(F.col(raw) - F.col(kept), F.lit(0))


def measures() -> list[Column]:
    """The measures of every rollup of runs; nulls count as not given."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"{c}_rate")
    return [
        F.count("*").alias("run_count"), F.count_if(F.col("success")).alias("successful_runs"),
        F.coalesce(F.avg("latency_ms").cast("bigint"), F.lit(0)).alias("avg_latency_ms"), F.coalesce(F.sum(saved()), F.lit(0)).alias("chars_saved"),
        rate("proof_usable"), rate("public_bootstrap_used"), rate("local_memory_used"),
    ]


def rollup(runs: DataFrame, key: Column, name: str) -> DataFrame:
    """Measures per key; blank and null keys are left out.  Partial aggregation
    runs before the shuffle, so a hot key costs no more than any other."""
    return runs.withColumn(name, key).where(F.trim(F.coalesce(name, F.lit(""))) != "").groupBy(name).agg(*measures())


def top(rows: DataFrame, name: str, limit: int) -> DataFrame:
    """The keys with the most runs."""
    return rows.orderBy(F.desc("run_count"), name).limit(limit)


def stats(runs: DataFrame) -> DataFrame:
    """One row: counts in one pass."""
    of = lambda op: F.count_if(F.col("operation") == op).alias(f"{op}_runs")
    return runs.agg(F.count("*").alias("run_count"), F.count_if("success").alias("successful_runs"), of("query"), of("read"), of("crawl"), F.max("completed_at").alias("last_run_at"))


def value_report(runs: DataFrame) -> DataFrame:
    """One row of totals and three ratios."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = runs.agg(
        F.count("*").alias("total_runs"), F.count_if("success").alias("successful_runs"), total("raw_fetch_chars").alias("raw_chars"), total(saved()).alias("chars_saved"),
        F.count_if("proof_usable").alias("proof_backed"), F.count_if(~F.col("public_bootstrap_used")).alias("bootstraps_avoided"), F.count_if("local_memory_used").alias("memory_reuse"),
        F.count_if("topic_node_used").alias("topic_corrections"), total("link_count").alias("links"), total("source_count").alias("sources"),
        F.coalesce(F.avg("latency_ms").cast("bigint"), F.lit(0)).alias("avg_latency_ms"), total("final_context_chars").alias("context_chars"),
    )
    return sums.select(
        "*", ratio(F.col("raw_chars") - F.col("context_chars"), F.col("raw_chars")).alias("compression_ratio"),
        ratio(F.col("proof_backed"), F.col("total_runs")).alias("proof_backed_rate"), ratio(F.col("memory_reuse"), F.col("total_runs")).alias("reuse_rate"),
    )


def upserted(runs: DataFrame, order: list[str]) -> DataFrame:
    """One row per run_id: the last by ``order``, with the first started_at.

    By aggregation, so a run_id that comes very often is folded before it is
    shuffled; ties are broken by the other columns.
    """
    rest = [c for c in runs.columns if c not in ("run_id", "started_at", *order)]
    first, last = F.min(F.struct(*order, "started_at")), F.max(F.struct(*order, *rest))
    folded = runs.groupBy("run_id").agg(first.alias("_first"), last.alias("_last"))
    return folded.select(*(f"_first.{c}" if c == "started_at" else f"_last.{c}" if c != "run_id" else c for c in runs.columns))


def outcomes(runs: DataFrame) -> DataFrame:
    """provider, at, outcome of the runs that name a provider: success, timeout
    (the slow failures) or failure."""
    outcome = F.when(F.col("success"), "success").when(F.col("latency_ms") >= 5000, "timeout").otherwise("failure")
    return runs.where("trim(provider) != ''").select("provider", "completed_at", "run_id", outcome.alias("outcome"))


#: Seconds for which a provider rests after an outcome (fixed values).
COOLDOWN = {"blocked": 900, "timeout": 300, "failure": 120, "unavailable": 60}


def provider_health(events: DataFrame, as_of: Column) -> DataFrame:
    """Counters, trailing failures, rest and health of each provider.

    ``events``: provider, completed_at, run_id, outcome.  The trailing streak
    is found without sorting a provider's events: it is the number of failures
    after its last success.
    """
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    at = F.struct("completed_at", "run_id")
    rest = F.expr("CASE outcome " + " ".join(f"WHEN '{k}' THEN completed_at + INTERVAL {v} SECONDS" for k, v in COOLDOWN.items()) + " END")
    sums = events.groupBy("provider").agg(
        *(count(o) for o in ["success", *COOLDOWN]), F.max(F.when(F.col("outcome") == "success", at)).alias("last_success"), F.max_by("outcome", at).alias("last_outcome"), F.max(rest).alias("cooldown_until"),
    )
    sums = stage(sums)
    later = join_small(events, sums.select("provider", "last_success"), ["provider"]).where((F.col("outcome") != "success") & (F.col("last_success").isNull() | (at > F.col("last_success"))))
    streaks = later.groupBy("provider").agg(F.count("*").alias("consecutive"))
    known = sums.join(streaks, "provider", "left").withColumn("consecutive", F.coalesce("consecutive", F.lit(0))).drop("last_success")
    cooling = F.coalesce(F.col("cooldown_until") > as_of, F.lit(False))
    health = F.expr("3 * success - 6 * blocked - 3 * timeout - 2 * failure - 2 * unavailable - 2 * consecutive")
    return known.select("*", cooling.alias("cooling"), (health - F.when(cooling, 20).otherwise(0) + F.when(F.col("last_outcome") == "success", 2).otherwise(0)).alias("health"))


def _slot(at: str) -> Column:
    """The hour of a time: no group of one key and slot holds more than an hour."""
    return F.date_trunc("hour", F.col(at).cast("timestamp"))


def paced(fetches: DataFrame, key: str, at: str, order: str, gap_ms: int) -> DataFrame:
    """When each fetch of a host may start if ``gap_ms`` have to lie between.

    The recurrence start = max(asked, start before + gap) has a closed form: the
    running maximum of asked - n * gap, plus n * gap.  It is taken in two steps,
    within the hours of a host and over its hours, so that a host with a large
    part of all fetches is spread over many tasks.  Fetches without a time have
    no start.
    """
    slots = fetches.withColumn("_slot", _slot(at)).withColumn("_asked", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("bigint"))
    within = Window.partitionBy(key, "_slot").orderBy(at, order)
    local = slots.withColumn("_n", F.row_number().over(within) * gap_ms)
    local = local.withColumn("_top", F.max(F.col("_asked") - F.col("_n")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    hours = local.groupBy(key, "_slot").agg((F.count("*") * gap_ms).alias("_size"), F.max(F.col("_asked") - F.col("_n")).alias("_most"))
    over = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per host and hour
    hours = hours.withColumn("_before", F.coalesce(F.sum("_size").over(over), F.lit(0))).withColumn("_reached", F.max(F.col("_most") - F.col("_before")).over(over)).drop("_size", "_most")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (key, "_slot")]
    joined = local.alias("l").join(hours.alias("h"), same[0] & same[1]).select("l.*", "h._before", "h._reached")
    start = F.greatest(F.col("_top") - F.col("_before"), F.col("_reached")) + F.col("_n") + F.col("_before")
    return joined.withColumn("start_ms", start).withColumn("waited_ms", F.col("start_ms") - F.col("_asked")).drop("_slot", "_asked", "_n", "_top", "_before", "_reached")


def as_of(rows: DataFrame, key: str, at: str, order: str, marked: Column) -> DataFrame:
    """With ``last_at``: the time of the last marked row of the key up to each
    row, of equal times marked rows first.  No pairs are made; hours of a key
    and a key's hours are scanned in two steps, as in ``paced``."""
    slots = rows.withColumn("_slot", _slot(at)).withColumn("_hit", F.when(marked, F.col(at)))
    within = Window.partitionBy(key, "_slot").orderBy(at, F.col("_hit").isNull(), order).rowsBetween(Window.unboundedPreceding, 0)
    local = slots.withColumn("_here", F.last("_hit", ignorenulls=True).over(within))
    over = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    hours = slots.groupBy(key, "_slot").agg(F.max("_hit").alias("_hit")).withColumn("_past", F.max("_hit").over(over)).drop("_hit")
    joined = local.join(hours, [key, "_slot"])
    return joined.withColumn("last_at", F.coalesce("_here", "_past")).drop("_slot", "_hit", "_here", "_past")

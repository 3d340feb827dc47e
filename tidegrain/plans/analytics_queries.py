"""Queries over run facts: rollups, keyed state, retention and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrain.functions.urls import host
from tidegrain.operators import analytics, keyed
from tidegrain.sources.tables import table

#: The time that rests and ages are measured at.
AS_OF = "2025-05-01 00:00:00"


def _runs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "analytics_runs")


def a01_run_stats(spark: SparkSession, root: str) -> DataFrame:
    return analytics.stats(_runs(spark, root))


def a02_value_report(spark: SparkSession, root: str) -> DataFrame:
    report = analytics.value_report(_runs(spark, root))
    return report.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in report.dtypes))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in rows.dtypes))


def a03_host_rollup(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(analytics.rollup(_runs(spark, root), F.col("host"), "host"))


def a03_top_hosts(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(analytics.top(analytics.rollup(_runs(spark, root), F.col("host"), "host"), "host", 20))


def a04_provider_rollup(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(analytics.rollup(_runs(spark, root), F.col("provider"), "provider"))


def a05_daily_rollup(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(analytics.rollup(_runs(spark, root), F.date_format("completed_at", "yyyy-MM-dd"), "day"))


def o04_recent_runs(spark: SparkSession, root: str) -> DataFrame:
    columns = ["run_id", "completed_at", "operation", "surface", "selected_url", "provider", "success", "latency_ms"]
    latest = keyed.newest(_runs(spark, root), ["run_id"], ["completed_at", "latency_ms", "packet_bytes"])
    return keyed.retained(latest.select(*columns, analytics.saved().alias("chars_saved")), [F.desc("completed_at"), F.col("run_id")], 20)


def k02_upserted_runs(spark: SparkSession, root: str) -> DataFrame:
    order = ["completed_at", "latency_ms", "packet_bytes"]
    return analytics.upserted(_runs(spark, root).select("run_id", "started_at", "operation", *order), order)


def a13_provider_health(spark: SparkSession, root: str) -> DataFrame:
    return analytics.provider_health(analytics.outcomes(_runs(spark, root)), F.lit(AS_OF).cast("timestamp_ntz"))


def o07_provider_order(spark: SparkSession, root: str) -> DataFrame:
    health = a13_provider_health(spark, root)
    order = Window.orderBy("cooling", F.desc("health"), "provider")  # as many rows as there are providers
    return health.select("provider", "cooling", "health", F.row_number().over(order).alias("position"))


def s08_paced_fetches(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "raw_pages").groupBy("page_no").agg(F.min("url").alias("url"), F.min("fetched_at").alias("fetched_at"))
    return analytics.paced(pages.withColumn("host", host(F.col("url"))).drop("url"), "host", "fetched_at", "page_no", 3_600_000).drop("fetched_at")


def a18_operation_counts(spark: SparkSession, root: str) -> DataFrame:
    of = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return _runs(spark, root).groupBy("trace_id").agg(of("operation", "query"), of("operation", "read"), of("operation", "crawl"), F.count("*").alias("events"))


def a19_trace_report(spark: SparkSession, root: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations")
    return _runs(spark, root).groupBy("trace_id").agg(F.count("*").alias("runs"), F.bool_and("success").alias("deterministic"), F.count_distinct("run_id").alias("distinct_runs"), names)


def a20_crawl_windows(spark: SparkSession, root: str) -> DataFrame:
    crawls = _runs(spark, root).where("operation = 'crawl'")
    return crawls.groupBy("profile").agg(F.min("started_at").alias("first_start"), F.max("completed_at").alias("last_end"), F.sum("link_count").alias("links"), F.sum("chunk_count").alias("chunks"))


def a21_grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    """Per (operation, profile), per operation and over all: integer averages."""
    runs = _runs(spark, root)
    summed = runs.rollup("operation", "profile").agg(
        F.count("*").alias("runs"), F.count_if("success").alias("passed"), F.sum("latency_ms").alias("latency"), F.sum("packet_bytes").alias("bytes"), F.grouping_id().cast("int").alias("level"),
    )
    return summed.select("operation", "profile", "level", "runs", "passed", F.expr("latency div runs").alias("avg_latency"), F.expr("bytes div runs").alias("avg_bytes"))


def a22_against_baseline(spark: SparkSession, root: str) -> DataFrame:
    """Averages per surface and their reduction against the whole."""
    runs = _runs(spark, root).where("packet_bytes > 0 AND latency_ms >= 0")
    each = runs.groupBy("surface").agg(F.count("*").alias("runs"), F.sum("packet_bytes").alias("total"), F.avg("latency_ms").alias("latency"))
    every = Window.partitionBy(F.lit(1))  # one row per surface
    whole = F.sum("total").over(every) / F.sum("runs").over(every)
    mean = F.col("total") / F.col("runs")
    return each.select("surface", "runs", F.round(mean, 4).alias("bytes"), F.round("latency", 4).alias("latency"), F.round(1 - mean / whole, 6).alias("reduction"))


def a23_warm_against_cold(spark: SparkSession, root: str) -> DataFrame:
    """Rates of runs with and without local memory and the improvement."""
    warm = F.col("local_memory_used")
    rate = lambda part, whole: F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6)
    sums = _runs(spark, root).groupBy("operation").agg(
        F.count_if(warm).alias("warm_runs"), F.count_if(warm & F.col("success")).alias("warm_passed"), F.count_if(~warm).alias("cold_runs"), F.count_if(~warm & F.col("success")).alias("cold_passed"),
    )
    return sums.select("*", rate(F.col("warm_passed"), F.col("warm_runs")).alias("warm_rate"), rate(F.col("cold_passed"), F.col("cold_runs")).alias("cold_rate")).withColumn("improvement", F.round(F.col("warm_rate") - F.col("cold_rate"), 6))


def a24_failure_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Failed runs by what is the matter with them, the first rule that holds."""
    failed = _runs(spark, root).where("NOT success")
    label = F.when(F.col("latency_ms") >= 5000, "timeout").when(F.coalesce("source_count", F.lit(0)) == 0, "no_source").when(F.coalesce("chunk_count", F.lit(0)) == 0, "no_chunk").when(~F.col("proof_usable"), "no_proof").otherwise("other")
    return failed.groupBy("operation", label.alias("failure")).agg(F.count("*").alias("runs"), F.count_distinct("host").alias("hosts"))


def a25_majority_vote(spark: SparkSession, root: str) -> DataFrame:
    """Per goal and profile over repeated runs: majority pass, most frequent
    provider (ties to the first by name) and the best run by packet size."""
    runs = _runs(spark, root).where("goal_hash IS NOT NULL")
    votes = runs.groupBy("goal_hash", "profile", "provider").agg(F.count("*").alias("n"))
    modal = votes.where("provider IS NOT NULL").groupBy("goal_hash", "profile").agg(F.min(F.struct((-F.col("n")).alias("m"), "provider"))["provider"].alias("provider"))
    sums = runs.groupBy("goal_hash", "profile").agg(
        F.count("*").alias("attempts"), (2 * F.count_if("success") >= F.count("*")).alias("passed"), F.min(F.struct(F.coalesce("packet_bytes", F.lit(2**62)), "run_id"))["run_id"].alias("best_run"),
    )
    return sums.join(modal, ["goal_hash", "profile"], "left")


def a26_threshold_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Hosts whose average latency or failure share is beyond a limit."""
    runs = _runs(spark, root).where("trim(host) != '' AND latency_ms >= 0")
    sums = runs.groupBy(F.lower(F.trim("host")).alias("host")).agg(F.count("*").alias("runs"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.max("latency_ms").alias("max_latency"), F.round(F.avg((~F.col("success")).cast("double")), 6).alias("failed"))
    return sums.where("runs >= 5 AND (avg_latency > 800 OR failed > 0.15)")


def a27_discovery_rates(spark: SparkSession, root: str) -> DataFrame:
    """Precision, activation and fallback of each discovery mode."""
    ratio = lambda part, whole: F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6)
    sums = _runs(spark, root).groupBy("discovery_mode").agg(
        F.count("*").alias("cases"), F.count_if("topic_node_used").alias("activated"), F.count_if(F.col("topic_node_used") & F.col("success")).alias("right"), F.count_if("public_bootstrap_used").alias("fallbacks"),
    )
    return sums.select("discovery_mode", "cases", ratio(F.col("right"), F.col("activated")).alias("precision"), ratio(F.col("activated"), F.col("cases")).alias("activation"), ratio(F.col("fallbacks"), F.col("cases")).alias("fallback"))


def o03_slowest_by_operation(spark: SparkSession, root: str) -> DataFrame:
    """The five slowest runs of each operation."""
    runs = keyed.newest(_runs(spark, root).where("latency_ms IS NOT NULL"), ["run_id"], ["completed_at", "latency_ms", "packet_bytes"])
    return keyed.newest(runs.select("operation", "run_id", "latency_ms"), ["operation"], ["latency_ms", "run_id"], 5)


def x_window_moving(spark: SparkSession, root: str) -> DataFrame:
    """Extension: per provider and day the runs, the running total and the mean
    over three days."""
    days = _runs(spark, root).where("trim(provider) != ''").groupBy("provider", F.to_date("completed_at").alias("day")).agg(F.count("*").alias("runs"))
    by = Window.partitionBy("provider").orderBy("day")
    return days.select("provider", "day", "runs", F.sum("runs").over(by).alias("running"), F.round(F.avg("runs").over(by.rowsBetween(-2, 0)), 6).alias("mean3"), F.lag("runs").over(by).alias("before"))


def x_as_of_runs(spark: SparkSession, root: str) -> DataFrame:
    """Extension, as-of join: the last crawl of a host before each of its reads."""
    runs = _runs(spark, root).where("trim(host) != ''").select(F.lower("host").alias("host"), "completed_at", "run_id", "operation").distinct()
    found = analytics.as_of(runs, "host", "completed_at", "run_id", F.col("operation") == "crawl")
    return found.where("operation = 'read'").select("host", "run_id", "completed_at", F.col("last_at").alias("crawled_at"))


QUERIES = {
    f.__name__: f
    for f in (
        a01_run_stats, a02_value_report, a03_host_rollup, a03_top_hosts, a04_provider_rollup, a05_daily_rollup, a13_provider_health, a18_operation_counts, a19_trace_report, a20_crawl_windows, a21_grouping_sets,
        a22_against_baseline, a23_warm_against_cold, a24_failure_clusters, a25_majority_vote, a26_threshold_alerts, a27_discovery_rates, k02_upserted_runs, o03_slowest_by_operation, o04_recent_runs, o07_provider_order,
        s08_paced_fetches, x_as_of_runs, x_window_moving,
    )
}

_MEASURES = """count(*) AS run_count, count(*) FILTER (success) AS successful_runs, coalesce(trunc(avg(latency_ms))::BIGINT, 0) AS avg_latency_ms,
  coalesce(sum(greatest(raw_fetch_chars - final_context_chars, 0)), 0)::BIGINT AS chars_saved, round(coalesce(avg(proof_usable::INT), 0), 6) AS proof_usable_rate,
  round(coalesce(avg(public_bootstrap_used::INT), 0), 6) AS public_bootstrap_used_rate, round(coalesce(avg(local_memory_used::INT), 0), 6) AS local_memory_used_rate"""
_LATEST = "(SELECT * FROM analytics_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC NULLS LAST, latency_ms DESC NULLS LAST, packet_bytes DESC NULLS LAST) = 1)"
_HEALTH = f"""
WITH e AS (SELECT provider, completed_at, run_id, CASE WHEN success THEN 'success' WHEN latency_ms >= 5000 THEN 'timeout' ELSE 'failure' END AS outcome FROM analytics_runs WHERE trim(provider) <> ''),
l AS (SELECT provider, max((completed_at, run_id)) FILTER (outcome = 'success') AS last_success, max_by(outcome, (completed_at, run_id)) AS last_outcome FROM e GROUP BY provider),
s AS (SELECT provider, count(*) FILTER (outcome = 'success') AS success, 0::BIGINT AS blocked, count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER (outcome = 'failure') AS failure, 0::BIGINT AS unavailable,
  max(CASE outcome WHEN 'timeout' THEN completed_at + INTERVAL 300 SECOND WHEN 'failure' THEN completed_at + INTERVAL 120 SECOND END) AS cooldown_until FROM e GROUP BY provider),
c AS (SELECT e.provider, count(*) AS consecutive FROM e JOIN l USING (provider) WHERE outcome <> 'success' AND (last_success IS NULL OR (completed_at, run_id) > last_success) GROUP BY e.provider),
h AS (SELECT s.*, last_outcome, coalesce(consecutive, 0) AS consecutive, coalesce(cooldown_until > TIMESTAMP '{AS_OF}', false) AS cooling FROM s JOIN l USING (provider) LEFT JOIN c USING (provider)),
health AS (SELECT *, 3 * success - 6 * blocked - 3 * timeout - 2 * failure - 2 * unavailable - 2 * consecutive - CASE WHEN cooling THEN 20 ELSE 0 END + CASE WHEN last_outcome = 'success' THEN 2 ELSE 0 END AS health FROM h)
"""
_HOST = "lower(nullif(regexp_extract(url, '(?i)^\\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), ''))"

SQL = {
    "a01_run_stats": "SELECT count(*) AS run_count, count(*) FILTER (success) AS successful_runs, count(*) FILTER (operation = 'query') AS query_runs, count(*) FILTER (operation = 'read') AS read_runs, count(*) FILTER (operation = 'crawl') AS crawl_runs, max(completed_at) AS last_run_at FROM analytics_runs",
    "a02_value_report": """
WITH s AS (SELECT count(*) AS total_runs, count(*) FILTER (success) AS successful_runs, coalesce(sum(raw_fetch_chars), 0)::BIGINT AS raw_chars, coalesce(sum(greatest(raw_fetch_chars - final_context_chars, 0)), 0)::BIGINT AS chars_saved,
  count(*) FILTER (proof_usable) AS proof_backed, count(*) FILTER (NOT public_bootstrap_used) AS bootstraps_avoided, count(*) FILTER (local_memory_used) AS memory_reuse, count(*) FILTER (topic_node_used) AS topic_corrections,
  coalesce(sum(link_count), 0)::BIGINT AS links, coalesce(sum(source_count), 0)::BIGINT AS sources, coalesce(trunc(avg(latency_ms))::BIGINT, 0) AS avg_latency_ms, coalesce(sum(final_context_chars), 0)::BIGINT AS context_chars FROM analytics_runs)
SELECT *, round(CASE WHEN raw_chars > 0 THEN (raw_chars - context_chars)::DOUBLE / raw_chars ELSE 0 END, 6) AS compression_ratio,
  round(CASE WHEN total_runs > 0 THEN proof_backed::DOUBLE / total_runs ELSE 0 END, 6) AS proof_backed_rate, round(CASE WHEN total_runs > 0 THEN memory_reuse::DOUBLE / total_runs ELSE 0 END, 6) AS reuse_rate FROM s""",
    "a03_host_rollup": f"SELECT host, {_MEASURES} FROM analytics_runs WHERE trim(coalesce(host, '')) <> '' GROUP BY host",
    "a03_top_hosts": f"SELECT host, {_MEASURES} FROM analytics_runs WHERE trim(coalesce(host, '')) <> '' GROUP BY host ORDER BY run_count DESC, host LIMIT 20",
    "a04_provider_rollup": f"SELECT provider, {_MEASURES} FROM analytics_runs WHERE trim(coalesce(provider, '')) <> '' GROUP BY provider",
    "a05_daily_rollup": f"SELECT strftime(completed_at, '%Y-%m-%d') AS day, {_MEASURES} FROM analytics_runs WHERE completed_at IS NOT NULL GROUP BY 1",
    "a13_provider_health": _HEALTH + "SELECT * FROM health",
    "a18_operation_counts": "SELECT trace_id, count(*) FILTER (operation = 'query') AS query, count(*) FILTER (operation = 'read') AS read, count(*) FILTER (operation = 'crawl') AS crawl, count(*) AS events FROM analytics_runs GROUP BY trace_id",
    "a19_trace_report": "SELECT trace_id, count(*) AS runs, bool_and(success) AS deterministic, count(DISTINCT run_id) AS distinct_runs, coalesce(string_agg(DISTINCT operation, ',' ORDER BY operation), '') AS operations FROM analytics_runs GROUP BY trace_id",
    "a20_crawl_windows": "SELECT profile, min(started_at) AS first_start, max(completed_at) AS last_end, sum(link_count)::BIGINT AS links, sum(chunk_count)::BIGINT AS chunks FROM analytics_runs WHERE operation = 'crawl' GROUP BY profile",
    "a21_grouping_sets": "SELECT operation, profile, grouping(operation, profile)::INTEGER AS level, count(*) AS runs, count(*) FILTER (success) AS passed, (sum(latency_ms)::BIGINT // count(*))::BIGINT AS avg_latency, (sum(packet_bytes)::BIGINT // count(*))::BIGINT AS avg_bytes FROM analytics_runs GROUP BY ROLLUP (operation, profile)",
    "a22_against_baseline": "WITH r AS (SELECT * FROM analytics_runs WHERE packet_bytes > 0 AND latency_ms >= 0) SELECT surface, count(*) AS runs, round(avg(packet_bytes), 4) AS bytes, round(avg(latency_ms), 4) AS latency, round(1 - avg(packet_bytes) / (SELECT avg(packet_bytes) FROM r), 6) AS reduction FROM r GROUP BY surface",
    "a23_warm_against_cold": """
WITH s AS (SELECT operation, count(*) FILTER (local_memory_used) AS warm_runs, count(*) FILTER (local_memory_used AND success) AS warm_passed, count(*) FILTER (NOT local_memory_used) AS cold_runs, count(*) FILTER (NOT local_memory_used AND success) AS cold_passed FROM analytics_runs GROUP BY operation),
r AS (SELECT *, round(CASE WHEN warm_runs > 0 THEN warm_passed / warm_runs ELSE 0 END, 6) AS warm_rate, round(CASE WHEN cold_runs > 0 THEN cold_passed / cold_runs ELSE 0 END, 6) AS cold_rate FROM s)
SELECT *, round(warm_rate - cold_rate, 6) AS improvement FROM r""",
    "a24_failure_clusters": "SELECT operation, CASE WHEN latency_ms >= 5000 THEN 'timeout' WHEN coalesce(source_count, 0) = 0 THEN 'no_source' WHEN coalesce(chunk_count, 0) = 0 THEN 'no_chunk' WHEN NOT proof_usable THEN 'no_proof' ELSE 'other' END AS failure, count(*) AS runs, count(DISTINCT host) AS hosts FROM analytics_runs WHERE NOT success GROUP BY 1, 2",
    "a25_majority_vote": """
WITH r AS (SELECT * FROM analytics_runs WHERE goal_hash IS NOT NULL),
v AS (SELECT goal_hash, profile, provider, row_number() OVER (PARTITION BY goal_hash, profile ORDER BY count(*) DESC, provider) AS rn FROM r WHERE provider IS NOT NULL GROUP BY goal_hash, profile, provider),
s AS (SELECT goal_hash, profile, count(*) AS attempts, 2 * count(*) FILTER (success) >= count(*) AS passed, min_by(run_id, (coalesce(packet_bytes, 4611686018427387904), run_id)) AS best_run FROM r GROUP BY goal_hash, profile)
SELECT s.*, v.provider FROM s LEFT JOIN v ON v.goal_hash = s.goal_hash AND v.profile = s.profile AND v.rn = 1""",
    "a26_threshold_alerts": "SELECT lower(trim(host)) AS host, count(*) AS runs, round(avg(latency_ms), 4) AS avg_latency, max(latency_ms) AS max_latency, round(avg((NOT success)::INT), 6) AS failed FROM analytics_runs WHERE trim(host) <> '' AND latency_ms >= 0 GROUP BY 1 HAVING runs >= 5 AND (avg_latency > 800 OR failed > 0.15)",
    "a27_discovery_rates": """
WITH s AS (SELECT discovery_mode, count(*) AS cases, count(*) FILTER (topic_node_used) AS activated, count(*) FILTER (topic_node_used AND success) AS hit, count(*) FILTER (public_bootstrap_used) AS fallbacks FROM analytics_runs GROUP BY discovery_mode)
SELECT discovery_mode, cases, round(CASE WHEN activated > 0 THEN hit / activated ELSE 0 END, 6) AS precision, round(activated / cases, 6) AS activation, round(fallbacks / cases, 6) AS fallback FROM s""",
    "k02_upserted_runs": "SELECT run_id, first_value(started_at) OVER (PARTITION BY run_id ORDER BY completed_at NULLS FIRST, latency_ms NULLS FIRST, packet_bytes NULLS FIRST) AS started_at, operation, completed_at, latency_ms, packet_bytes FROM analytics_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC NULLS LAST, latency_ms DESC NULLS LAST, packet_bytes DESC NULLS LAST) = 1",
    "o03_slowest_by_operation": f"SELECT operation, run_id, latency_ms FROM {_LATEST.replace('FROM analytics_runs', 'FROM analytics_runs WHERE latency_ms IS NOT NULL')} QUALIFY row_number() OVER (PARTITION BY operation ORDER BY latency_ms DESC, run_id DESC) <= 5",
    "o04_recent_runs": f"SELECT run_id, completed_at, operation, surface, selected_url, provider, success, latency_ms, greatest(raw_fetch_chars - final_context_chars, 0) AS chars_saved FROM {_LATEST} ORDER BY completed_at DESC, run_id LIMIT 20",
    "o07_provider_order": _HEALTH + "SELECT provider, cooling, health, row_number() OVER (ORDER BY cooling, health DESC, provider)::INTEGER AS position FROM health",
    "s08_paced_fetches": f"""
WITH p AS (SELECT page_no, min(url) AS url, min(fetched_at) AS fetched_at FROM raw_pages GROUP BY page_no),
n AS (SELECT page_no, {_HOST} AS host, epoch_us(fetched_at) // 1000 AS asked, row_number() OVER (PARTITION BY {_HOST} ORDER BY fetched_at, page_no) * 3600000 AS n FROM p),
s AS (SELECT page_no, host, asked, max(asked - n) OVER (PARTITION BY host ORDER BY n ROWS UNBOUNDED PRECEDING) + n AS start_ms FROM n)
SELECT page_no, host, start_ms::BIGINT AS start_ms, (start_ms - asked)::BIGINT AS waited_ms FROM s""",
    "x_as_of_runs": """
WITH r AS (SELECT DISTINCT lower(host) AS host, completed_at, run_id, operation FROM analytics_runs WHERE trim(host) <> '')
SELECT host, run_id, completed_at, (SELECT max(c.completed_at) FROM r c WHERE c.host = a.host AND c.operation = 'crawl' AND c.completed_at <= a.completed_at) AS crawled_at FROM r a WHERE operation = 'read'""",
    "x_window_moving": """
WITH d AS (SELECT provider, completed_at::DATE AS day, count(*) AS runs FROM analytics_runs WHERE trim(provider) <> '' GROUP BY 1, 2)
SELECT provider, day, runs, sum(runs) OVER w::BIGINT AS running, round(avg(runs) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3, lag(runs) OVER w AS before FROM d WINDOW w AS (PARTITION BY provider ORDER BY day)""",
}

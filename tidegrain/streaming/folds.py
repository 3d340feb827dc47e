"""Keyed state that grows with a stream, each with a batch twin elsewhere."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrain.operators import analytics, keyed
from tidegrain.runtime import shared_dir


def stream_table(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    path = f"{root}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)  # the pattern below takes a file as well as a folder
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}*")


def _listed(spark: SparkSession, place: str) -> list[str]:
    """Names in a folder of the shared storage; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def _place(spark: SparkSession, place: str | None) -> str:
    return place or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str, place: str | None = None) -> DataFrame:
    """All that a stream has now, run to its end; its last state as a table.

    In complete mode each batch replaces the table; in append mode it adds to
    it.  The checkpoint and the table are in ``place``, by default a new folder
    of the shared one; run again with the same place a stream goes on where it
    stopped.  A batch is written under its number, so one that is tried again
    after a failure replaces itself.
    """
    spark = stream.sparkSession
    place = _place(spark, place)
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table/{0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = _listed(spark, f"{place}/table")
    return spark.read.schema(schema).parquet(*(f"{place}/table/{p}" for p in parts)) if parts else spark.createDataFrame([], schema)


def appended_runs(runs: DataFrame) -> DataFrame:
    """Run facts as they arrive."""
    return runs.select("run_id", "completed_at", "operation", "latency_ms")


def upserted_stream(stream: DataFrame, key: list[str], order: list[str], columns: list[str], place: str | None = None) -> DataFrame:
    """The newest row per key of all batches so far.

    Each batch reads the table of the batch before and writes its own, named by
    its number; both stay, so a batch that is tried again, also after a restart
    from the checkpoint in ``place``, finds what it read before.
    """
    spark = stream.sparkSession
    place = _place(spark, place)
    schema = stream.select(*columns).schema

    def tables() -> list[int]:
        return sorted(int(name.removeprefix("table-")) for name in _listed(spark, place) if name.startswith("table-"))

    def put(batch: DataFrame, number: int) -> None:
        own = keyed.newest(batch.select(*columns), key, order)
        before = [n for n in tables() if n < number]
        merged = keyed.upsert(spark.read.schema(schema).parquet(f"{place}/table-{before[-1]}"), own, key, order) if before else own
        merged.write.mode("overwrite").parquet(f"{place}/table-{number}")
        for old in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/table-{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = tables()
    return spark.read.schema(schema).parquet(f"{place}/table-{done[-1]}") if done else spark.createDataFrame([], schema)


def host_profiles(documents: DataFrame) -> DataFrame:
    """Folds per host: count, most, any; see the batch query of the same name."""
    return documents.where("trim(host) != ''").groupBy(F.lower("host").alias("host")).agg(F.count("*").alias("seen"), F.max("n_chars").alias("most_chars"), F.max(F.coalesce("changed_recently", F.lit(False)).cast("int")).alias("ever_changed"))


def daily_rollup(runs: DataFrame, late: str = "30 days") -> DataFrame:
    """Measures per UTC day, with a watermark for late runs."""
    timed = runs.withColumn("at", F.col("completed_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w")).agg(*analytics.measures()).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "run_count", "successful_runs", "avg_latency_ms", "chars_saved")


def tumbling_counts(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Extension: events and their value per type and window; sliding with ``slide``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Extension: runs of a user's events with no longer gap than ``gap``."""
    timed = events.where("user_id IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    grouped = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


_HEALTH = "provider string, success long, timeout long, failure long, consecutive long"


def provider_health(outcomes: DataFrame) -> DataFrame:
    """Counters and trailing failures of each provider as state.

    ``outcomes``: provider, completed_at, run_id, outcome.  Outcomes of one
    batch are taken in order of time; one that comes in a later batch than it
    should counts as later.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        success, timeout, failure, streak = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["completed_at", "run_id"])
        for outcome in rows["outcome"]:
            success, timeout, failure = success + (outcome == "success"), timeout + (outcome == "timeout"), failure + (outcome == "failure")
            streak = 0 if outcome == "success" else streak + 1
        state.update((success, timeout, failure, streak))
        yield pd.DataFrame([(key[0], success, timeout, failure, streak)], columns=["provider", "success", "timeout", "failure", "consecutive"])

    return outcomes.groupBy("provider").applyInPandasWithState(fold, _HEALTH, "success long, timeout long, failure long, streak long", "update", GroupStateTimeout.NoTimeout)


def snapshot_deltas(records: DataFrame) -> DataFrame:
    """Fingerprints of a document retained, added and removed at each of its
    snapshots, against the one before, which is kept as state.

    A document's snapshots have to come in order from batch to batch.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches))
        out = []
        for number, part in rows.groupby("snapshot_no"):
            now = sorted(set(part["fp"]))
            out.append((key[0], int(number), len(set(now) & set(last)), len(set(now) - set(last)), len(set(last) - set(now))))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["document_id", "snapshot_no", "retained", "added", "removed"])

    keyed_rows = records.where("fingerprint IS NOT NULL AND document_id IS NOT NULL").select("document_id", "snapshot_no", F.lower(F.trim("fingerprint")).alias("fp"))
    return keyed_rows.groupBy("document_id").applyInPandasWithState(fold, "document_id long, snapshot_no int, retained long, added long, removed long", "last array<string>", "append", GroupStateTimeout.NoTimeout)



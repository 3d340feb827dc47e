"""Keyed tables: upsert, retention, merging and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row per key of both tables; ties go to the incoming one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(both, key, [*order, "_new"]).drop("_new")


def newest(rows: DataFrame, key: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The ``n`` last rows per key by ``order``; Spark limits each partition to
    ``n`` rows a key before it shuffles."""
    by = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= n).drop("_rn")


def retained(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of a table by ``order``."""
    return rows.orderBy(*order).limit(n)


def pruned(rows: DataFrame, at: str, before: Column) -> DataFrame:
    """Rows that are not older than ``before``; rows without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= before))


def max_merge(candidates: DataFrame) -> DataFrame:
    """url, label, score, reasons, sources of candidates: the greatest score, the first
    filled label by score, all reasons."""
    label = F.max_by(F.when(F.trim("label") != "", F.col("label")), F.when(F.trim("label") != "", F.struct("score", "label")))
    return candidates.groupBy("url").agg(
        F.max("score").alias("score"), label.alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.count("*").alias("sources"),
    )


def seen_counts(rows: DataFrame, key: str, at: str, source: str) -> DataFrame:
    """Times seen, first and last time and the sources of each key."""
    return rows.where(F.trim(key) != "").groupBy(key).agg(F.count("*").alias("seen"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.array_sort(F.collect_set(source)).alias("sources"))


def delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """retained, added or removed for every distinct key of two tables."""
    a = old.select(*key).distinct().withColumn("_old", F.lit(True))
    b = new.select(*key).distinct().withColumn("_new", F.lit(True))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("retained")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def transitions(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows before and after each transition of numbered snapshots, under
    the number of the later one."""
    least, most = snapshots.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    old = snapshots.where(F.col("snapshot_no") < F.lit(most)).withColumn("snapshot_no", F.col("snapshot_no") + 1)
    return old, snapshots.where(F.col("snapshot_no") > F.lit(least))


def changed_values(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """added, removed or changed for the keys whose value differs."""
    a = old.select(*key, F.col(value).alias("old_value"), F.lit(True).alias("_old"))
    b = new.select(*key, F.col(value).alias("new_value"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return a.join(b, key, "full_outer").select(*key, "old_value", "new_value", status.alias("status")).where("status IS NOT NULL")

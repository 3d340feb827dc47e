"""JSON lines and bundles: exports that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrain.operators import analytics, keyed


def export_lines(rows: DataFrame, path: str, order: list[Column]) -> None:
    """Write a table as JSON lines in order: the files in order of their names.

    Sorting is by ranges, so that no task holds the table.
    """
    rows.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_lines(spark: SparkSession, path: str, schema: StructType, known: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Lines read with a stated schema and put over the rows known so far;
    lines that don't parse are left out."""
    raw = spark.read.schema(StructType([*schema.fields]).add("_corrupt", "string")).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return keyed.upsert(known, raw.where("_corrupt IS NULL").drop("_corrupt"), key, order)


def export_bundle(runs: DataFrame, folder: str) -> None:
    """Run facts and their rollups, one folder of JSON lines each."""
    export_lines(runs, f"{folder}/runs", [F.desc("completed_at"), F.col("run_id")])
    for name, key in (("hosts", F.col("host")), ("providers", F.col("provider")), ("daily", F.date_format("completed_at", "yyyy-MM-dd"))):
        rolled = analytics.rollup(runs, key, "key")
        export_lines(rolled, f"{folder}/{name}", [F.desc("run_count"), F.col("key")])
    analytics.value_report(runs).write.mode("overwrite").json(f"{folder}/value_report")


def save_by_trace(rows: DataFrame, path: str) -> None:
    """Artifacts of each trace below a folder of its first two hex digits, so
    that a lookup reads one folder and the folders stay few."""
    rows.withColumn("part", F.substring(F.sha2(F.coalesce("trace_id", F.lit("")), 256), 1, 2)).write.mode("overwrite").partitionBy("part").parquet(path)


def load_trace(spark: SparkSession, path: str, trace_id: str) -> DataFrame:
    """The artifacts of one trace; other folders are not read."""
    part = spark.range(1).select(F.substring(F.sha2(F.lit(trace_id), 256), 1, 2)).first()[0]
    return spark.read.parquet(path).where((F.col("part") == part) & (F.col("trace_id") == trace_id)).drop("part")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON corpus of one object with an array ``cases``."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("case")).select("case.*")

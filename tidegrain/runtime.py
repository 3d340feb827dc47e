"""Session settings, shared-storage staging and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a broadcast side may have at most.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20
#: Copies of the small side when a join beyond the bound has to be salted.
SALTS = 16


def session(app: str = "tidegrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` is read first, then the checkpoint folder of the
    context.  Only a local master may get a temporary folder of its own; on a
    cluster without either an error is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidegrain-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Staged tables of this process that are still there.
_STAGED: dict[str, Staged] = {}


class Staged:
    """A DataFrame written to shared storage: lineage ends at the files."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tidegrain-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _STAGED[self.path] = self

    def drop(self) -> None:
        """Delete the files; only for results that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        _STAGED.pop(self.path, None)


@contextmanager
def staging() -> Iterator[None]:
    """Everything staged inside is deleted at the end; results have to be
    written or collected before.

        with staging():
            engine.query(pages, goals).write.parquet(target)
    """
    before = set(_STAGED)
    try:
        yield
    finally:
        for path in set(_STAGED) - before:
            _STAGED[path].drop()


def stage(df: DataFrame) -> DataFrame:
    """Write to shared storage and read back; survives lost executors."""
    return Staged(df).df


def broadcast_cost(rows: DataFrame, known: int | None = None) -> tuple[int, int]:
    """Rows and bytes of a table; what is of fixed width is not read."""
    wide = [f for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    fixed = 16 + 8 * len(rows.columns)
    if known is not None and not wide:
        return known, known * fixed
    size = lambda f: F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.octet_length(F.to_json(F.struct(F.col(f.name)))) * 2
    more = sum((F.coalesce(F.sum(size(f)), F.lit(0)) for f in wide), F.lit(0))
    n, extra = rows.agg(F.count("*"), more).first()
    return n, n * fixed + extra


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small, without assuming that it is.

    ``rows`` is the row count of ``right`` (counted here if not given, so
    ``right`` should be staged).  Up to ``limit`` rows and BROADCAST_BYTES it is
    broadcast.  Beyond that both sides are shuffled with a salt, so that one key
    holding a large part of ``left`` is spread over SALTS tasks.  ``how`` may be
    inner, left, left_semi or left_anti: each left row meets all its matches
    either way.
    """
    if rows is None or rows <= limit:
        rows, size = broadcast_cost(right, rows)
        if rows <= limit and size <= BROADCAST_BYTES:
            return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return keyed.join(salted, [*on, "_salt"], how).drop("_salt")


def map_groups(rows: DataFrame, group: str, change: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Rows of ``change`` for the rows of each group; for groups of bounded
    size, such as the segments of one page.

    Groups are gathered by an aggregation, which keeps a partitioning by the
    group that is there already, and go to Python many at a time.
    """
    names = [field.name for field in rows.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for own in batch["rows"] for r in change([x if isinstance(x, dict) else x.asDict() for x in own])]
            yield pd.DataFrame([[r[n] for n in names] for r in out], columns=names, dtype=object)

    packed = rows.groupBy(group).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return packed.select("rows").mapInPandas(run, schema)


def columns_of(rows: DataFrame) -> str:
    """The columns of a table as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

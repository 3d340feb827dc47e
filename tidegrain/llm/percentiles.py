"""Percentiles of very large numeric columns, per group.

A day delivers its runs, each once; days are combined by keeping the latest
delivery of each run, so a run that comes again on another day still counts
once.  Readings are counted by value, and the percentiles of all groups are then
selected together by distributed multi-select: each block of a partition
proposes the local medians of the readings that are still possible (the median,
those of the halves, of the quarters and so on), the weighted medians of all
proposals become the pivots, readings at and between the pivots are counted,
the ranges no wanted rank lies in are discarded, and this is repeated until each
percentile is found.  There is no other way to a result, however small a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.runtime import Staged, join_small, stage

#: Percentiles selected, in percent.
PERCENTS = (50, 90, 95, 99)
METRICS = ("latency_ms", "packet_bytes")
#: Pivots of a range in one round; 1 is the plain three-way split.
PIVOTS = 15
#: Values of a group that lie in one partition; larger groups are split.
CHUNK_VALUES = 1 << 20
#: Rows of a partition that make their proposals together.
BLOCK = 1 << 17
#: Ranges whose pivots are sent to all executors (about 150 bytes each).
BROADCAST_RANGES = 200_000
_GROUP = ["scope", "operation", "host", "metric"]


def _latest(runs: DataFrame, keys: list[str]) -> DataFrame:
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    best = F.max(F.struct("completed_at", "started_at", *METRICS, clean(F.col("operation")).alias("operation"), clean(F.lower("host")).alias("host"))).alias("r")
    return runs.where("run_id IS NOT NULL").groupBy(*keys).agg(best).select("run_id", "r.*")


def unique_runs(runs: DataFrame) -> DataFrame:
    """Each run_id once, as completed last; ties by the greatest values.

    A null run_id is no run.  Blank and null hosts and operations become null,
    hosts are trimmed and lower-cased.
    """
    return _latest(runs, ["run_id"])


def day_parts(runs: DataFrame) -> DataFrame:
    """What single days deliver: the runs of each day of ``completed_at``, each
    once a day, with all that is needed to combine days."""
    return _latest(runs.withColumn("_day", F.to_date("completed_at")), ["_day", "run_id"])


def combine(parts: list[DataFrame]) -> DataFrame:
    """The runs of several days together, each once; the order of the days and
    parts given twice make no difference."""
    return unique_runs(reduce(DataFrame.unionByName, parts))


def rounded(value: Column, bits: int | None) -> Column:
    """The value with ``bits`` significant bits, or as it is.

    Rounding down to a multiple of 2**(b - bits), b the bits of the value, is
    off by less than 2**(1 - bits) of the value.
    """
    if bits is None:
        return value
    step = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int") + 1 - bits)
    return F.call_function("shiftleft", F.call_function("shiftright", value, step), step)


def value_counts(runs: DataFrame, bits: int | None = None) -> DataFrame:
    """(operation, host, metric, value, n) of runs that are there once.

    Null and negative readings are left out, each of a run on its own.  With
    ``bits`` values are rounded, see ``rounded``, so there are at most 2**bits
    of them a power of two.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in METRICS)))
    readings = runs.select("operation", "host", pairs.alias("p")).where("p.value >= 0")
    return readings.groupBy("operation", "host", "p.metric", rounded(F.col("p.value"), bits).alias("value")).agg(F.count("*").alias("n"))


def scopes(counts: DataFrame) -> DataFrame:
    """Counts per operation, per host and per both; groups without a name of
    their scope are left out, as are nulls."""
    null = F.lit(None).cast("string")
    ways = F.explode(F.array(
        F.struct(F.lit("operation").alias("scope"), F.col("operation").alias("o"), null.alias("h")),
        F.struct(F.lit("host").alias("scope"), null.alias("o"), F.col("host").alias("h")),
        F.struct(F.lit("operation_host").alias("scope"), F.col("operation").alias("o"), F.col("host").alias("h")),
    ))
    rows = counts.select("operation", "host", "metric", "value", "n", ways.alias("w"))
    named = rows.where("(w.scope = 'host' OR w.o IS NOT NULL) AND (w.scope = 'operation' OR w.h IS NOT NULL)")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return named.select(F.col("w.scope").alias("scope"), blank(F.col("w.o")).alias("operation"), blank(F.col("w.h")).alias("host"), "metric", "value", "n")


def _local_medians(rows: pd.DataFrame, pivots: int) -> pd.DataFrame:
    """Up to ``pivots`` proposals of each range of a block: with one the
    weighted median of its values, with 2^i - 1 also those of the parts."""
    rows = rows.sort_values(["range", "value"], kind="stable")
    ranges, value, n = (rows[c].to_numpy() for c in ("range", "value", "n"))
    first = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
    size, upto = np.diff(np.r_[first, len(ranges)]), np.cumsum(n)
    before, total = upto[first] - n[first], np.add.reduceat(n, first)
    few = np.repeat(size <= pivots, size)  # all of them are proposed
    share = np.arange(1, pivots + 1) / (pivots + 1)
    wide = np.flatnonzero(size > pivots)
    at = np.searchsorted(upto, (before[wide, None] + np.ceil(total[wide, None] * share)).astype(np.int64)).ravel()
    weight = np.repeat(np.maximum(total[wide] // pivots, 1), pivots)
    return pd.DataFrame({"range": np.r_[ranges[few], ranges[at]], "value": np.r_[value[few], value[at]], "weight": np.r_[n[few], weight]})


def _proposer(pivots: int, block: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= block:
                yield _local_medians(pd.concat(held), pivots)
                held, rows = [], 0
        if rows:
            yield _local_medians(pd.concat(held), pivots)

    return run


def _pivots(live: DataFrame, pivots: int, block: int) -> DataFrame:
    """(range, pivots): the weighted medians of the proposals, in order."""
    proposed = live.mapInPandas(_proposer(pivots, block), "range long, value long, weight long")
    proposed = proposed.groupBy("range", "value").agg(F.sum("weight").alias("weight"))
    whole, order = Window.partitionBy("range"), Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = proposed.select("range", "value", "weight", F.sum("weight").over(order).alias("upto"), F.sum("weight").over(whole).alias("all"), F.count("*").over(whole).alias("distinct"))
    step = lambda c: F.floor(c * (pivots + 1) / F.col("all"))
    chosen = ranked.where((F.col("distinct") <= pivots) | (step(F.col("upto")) > step(F.col("upto") - F.col("weight"))))
    return chosen.groupBy("range").agg(F.array_sort(F.collect_list("value")).alias("pivots"))  # pivots + 1 at most


def _slot(value: Column, pivots: Column, most: int) -> Column:
    """Twice the number of pivots below the value, one more if it is a pivot."""
    at, step = F.lit(0), 1 << (most.bit_length() - 1)
    while step:
        beyond = F.get(pivots, at + (step - 1)) < value
        at, step = at + F.when(beyond, step).otherwise(0), step // 2
    return at * 2 + F.when(F.get(pivots, at) == value, 1).otherwise(0)


def select(values: DataFrame, group: list[str], percents: tuple[int, ...] = PERCENTS, pivots: int = PIVOTS, chunk_values: int = CHUNK_VALUES, block: int = BLOCK) -> DataFrame:
    """(*group, percent, value, n): the percentiles of each group, exactly.

    ``values``: the columns ``group``, value long, n long; read twice.  The
    percentile p of n readings is the reading of rank ceil(p * n / 100), so it
    is one of them; the error is that of the values given, 0 if they are not
    rounded.  Values that occur more than once in a group are added up first.
    An empty table has no groups.
    """
    keyed = values.withColumn("g", F.xxhash64(*group))
    totals = stage(keyed.groupBy(*group, "g").agg(F.sum("n").alias("total"), F.count("*").alias("rows")))
    large = stage(totals.where(F.col("rows") > chunk_values).select("g", F.ceil(F.col("rows") / chunk_values).alias("chunks")))
    split = join_small(keyed.select("g", "value", "n"), large, ["g"], "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("value"), F.col("chunks")), F.lit(0)))
    once = split.repartition("g", "chunk").groupBy("g", "chunk", "value").agg(F.sum("n").alias("n"))  # in the same partitions
    live = Staged(once.select(F.col("g").alias("range"), "value", "n").sortWithinPartitions("range", "value"))
    rank = lambda p: F.greatest(F.lit(1), F.floor((F.col("total") * p + 99) / 100).cast("long"))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), rank(p).alias("rank")) for p in percents)))
    open_ = totals.select("g", F.col("g").alias("range"), wanted.alias("r")).select("g", "range", "r.percent", "r.rank")
    n_open, found = totals.count(), []
    while n_open:
        chosen = stage(_pivots(live.df, pivots, block))
        split = join_small(live.df, chosen, ["range"], rows=n_open, limit=BROADCAST_RANGES)
        counts = split.groupBy("range", _slot(F.col("value"), F.col("pivots"), pivots + 1).alias("slot")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        order = Window.partitionBy("range").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 * pivots + 3 slots
        placed = counts.withColumn("upto", F.sum("n").over(order)).join(open_.select("g", "range", "percent", "rank"), "range")
        placed = placed.where((F.col("upto") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
        placed = stage(placed.select("g", F.col("range").alias("outer"), F.xxhash64("range", "slot").alias("range"), "low", "high", "percent", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
        found.append(placed.where("low = high").select("g", "percent", F.col("low").alias("value")))
        open_ = placed.where("low < high")
        n_open = open_.count()
        if n_open:
            ranges = open_.select("outer", "range", "low", "high").distinct()
            kept = join_small(live.df.withColumnRenamed("range", "outer"), ranges, ["outer"], rows=n_open)
            smaller = Staged(kept.where("value BETWEEN low AND high").select("range", "value", "n"))
            live.drop()
            live = smaller
    if not found:
        return totals.select(*group, F.lit(0).alias("percent"), F.lit(0).cast("long").alias("value"), F.col("total").alias("n")).limit(0)
    return totals.select(*group, "g", "total").join(reduce(DataFrame.unionByName, found), "g").select(*group, "percent", "value", F.col("total").alias("n"))


def percentiles(counts: DataFrame, percents: tuple[int, ...] = PERCENTS, **options: int) -> DataFrame:
    """(scope, operation, host, metric, percent, value, n) from ``value_counts``.

    ``scope`` is operation, host or operation_host; the name that is not part
    of a scope is empty.
    """
    return select(scopes(stage(counts)), _GROUP, percents, **options)

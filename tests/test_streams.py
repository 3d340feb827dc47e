"""Streams over several batches against their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrain.operators import analytics
from tidegrain.streaming import folds

T0 = datetime(2025, 1, 1)


@pytest.fixture
def events(spark, tmp_path):  # noqa: ANN001, ANN201
    """Six files, read one per batch."""
    rows = [(i, T0 + timedelta(minutes=13 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    for part in range(6):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def rows(frame):  # noqa: ANN001, ANN201
    return sorted(tuple(r) for r in frame.collect())


def test_windows(spark, events):  # noqa: ANN001
    batch = spark.read.parquet(f"{events}/events.parquet")
    stream = folds.stream_table(spark, events, "events", 1)
    want = batch.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz"), "event_type").agg(F.count("*"), F.sum("value"))
    assert rows(folds.drained(folds.tumbling_counts(stream, "1 hour"), "complete")) == rows(want)
    assert sum(r.n for r in folds.drained(folds.tumbling_counts(stream, "2 hours", "1 hour"), "complete").collect()) == 120
    assert rows(folds.drained(folds.sessions(stream, "30 minutes"), "complete").groupBy("user_id").agg(F.sum("n"))) == [(0, 20), (1, 20), (2, 20)]


def test_upserts_of_several_batches(spark, events):  # noqa: ANN001
    stream = folds.stream_table(spark, events, "events", 1)
    found = folds.upserted_stream(stream, ["user_id"], ["ts"], ["user_id", "ts", "value"])
    assert [(u, v) for u, _, v in rows(found)] == [(0, 57.0), (1, 58.0), (2, 59.0)]


def test_health_keeps_its_streak(spark, tmp_path):  # noqa: ANN001
    outcomes = ["success", "failure", "failure", "success", "failure", "timeout", "failure"]
    for i, o in enumerate(outcomes):
        one = [("p", T0 + timedelta(minutes=i), f"r{i}", o == "success", 6000 if o == "timeout" else 1)]
        spark.createDataFrame(one, "provider string, completed_at timestamp_ntz, run_id string, success boolean, latency_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs.parquet")
    stream = folds.stream_table(spark, str(tmp_path), "runs")
    last = folds.drained(folds.provider_health(analytics.outcomes(stream)), "update").collect()
    assert [tuple(r) for r in last] == [("p", 2, 1, 4, 3)]


def test_deltas(spark, tmp_path):  # noqa: ANN001
    data = [(1, "A", 7), (1, "b", 7), (2, " a", 7), (2, "c", 7), (2, "c", 7), (3, None, 7), (1, "z", None)]
    spark.createDataFrame(data, "snapshot_no int, fingerprint string, document_id long").write.parquet(f"{tmp_path}/prints.parquet")
    found = folds.drained(folds.snapshot_deltas(folds.stream_table(spark, str(tmp_path), "prints")), "append")
    assert rows(found) == [(7, 1, 0, 2, 0), (7, 2, 1, 1, 1)]


def test_nothing_to_read(spark, tmp_path):  # noqa: ANN001
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert folds.drained(folds.sessions(folds.stream_table(spark, str(tmp_path), "events"), "1 hour"), "complete").collect() == []


def test_restart(spark, tmp_path):  # noqa: ANN001
    """A stream that is run again with its checkpoint keeps what it had, and a
    batch that is tried again counts once."""
    def add(first):  # noqa: ANN001, ANN202
        made = [(i, T0 + timedelta(minutes=i), i % 5, "a", float(i)) for i in range(first, first + 5)]
        spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    def run():  # noqa: ANN202
        stream = folds.stream_table(spark, str(tmp_path), "events", 1)
        upserted = folds.upserted_stream(stream, ["event_id"], ["ts"], ["event_id", "ts", "value"], place=f"{tmp_path}/upserted")
        appended = folds.drained(folds.stream_table(spark, str(tmp_path), "events", 1).select("event_id"), "append", place=f"{tmp_path}/appended")
        return sorted(r.event_id for r in upserted.collect()), sorted(r.event_id for r in appended.collect())

    for first in (0, 5, 10):
        add(first)
        assert run() == (list(range(first + 5)),) * 2
    for name in ("upserted", "appended"):  # as if the last batch had failed after its write
        (commit,) = sorted((tmp_path / name / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1:]
        commit.unlink()
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    assert run() == (list(range(15)),) * 2

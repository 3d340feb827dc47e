"""Changes between snapshots against a comparison of dictionaries."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrain.operators import snapshots

from tidegrain.operators.snapshots import document_changes, fingerprint_changes

T0 = datetime(2025, 1, 1)
FIELDS = "snapshot_no int, url string, stable_ratio double, novelty_ratio double, changed_recently boolean, updated_at timestamp_ntz, delivered_at timestamp_ntz, title string, _ string, value int, k1 string"


def row(n, url, stable=0.5, novelty=0.5, changed=False, at=0):  # noqa: ANN001, ANN201
    return (n, url, stable, novelty, changed, T0 + timedelta(hours=at), T0 + timedelta(days=at), "t", "x", 1, "y")


def changes(spark, rows, **sizes):  # noqa: ANN001, ANN201
    found = document_changes(spark.createDataFrame(rows, FIELDS), **sizes).collect()
    return sorted((r.snapshot_no, r.record_key, r.change_kind) for r in found)


def same(a, b):  # noqa: ANN001, ANN201
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-6


def test_rules(spark):  # noqa: ANN001
    nan = float("nan")
    rows = [
        row(1, " HTTP://A.example/x "), row(2, "http://a.example/x", stable=0.5 + 1e-9),  # noise is no change
        row(1, "b", nan), row(2, "b", nan), row(1, "c", None), row(2, "c", None), row(1, "d", None), row(2, "d", nan),
        row(1, "e"), row(3, "e"),  # gone and back again
        row(1, "f", 0.1), row(2, "f", 0.1), row(2, "f", 0.7, at=-5), row(2, "f", 0.1),  # superseded and repeated rows
        row(1, "g", float("inf")), row(2, "g", float("-inf")), row(2, None), row(2, "  "), row(None, "z"),
    ]
    gone = [(3, k, "removed") for k in ("b", "c", "d", "f", "g", "http://a.example/x")]
    assert changes(spark, rows) == sorted([(2, "d", "changed"), (2, "e", "removed"), (2, "g", "changed"), (3, "e", "added"), *gone])


def test_empty_and_single(spark):  # noqa: ANN001
    assert changes(spark, []) == []
    assert changes(spark, [row(1, "a"), row(1, "b")]) == []


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 50, "first_cells": 2}])
def test_against_dictionaries(spark, sizes):  # noqa: ANN001
    """Small first tables make buckets fail and be enlarged."""
    rng = random.Random(7)
    states = []
    for n in (1, 2, 3):
        before = states[-1] if states else {f"u{i}": rng.random() for i in range(400)}
        now = {k: (rng.random() if rng.random() < 0.2 else v) for k, v in before.items() if rng.random() > 0.1}
        now |= {f"n{n}-{i}": rng.random() for i in range(40)}
        states.append(now)
    rows = [row(n, k, v) for n, s in enumerate(states, 1) for k, v in s.items()]
    want = []
    for n, (old, new) in enumerate(zip(states, states[1:]), 2):
        want += [(n, k, "added") for k in new.keys() - old.keys()] + [(n, k, "removed") for k in old.keys() - new.keys()]
        want += [(n, k, "changed") for k in new.keys() & old.keys() if not same(old[k], new[k])]
    assert changes(spark, rows, **sizes) == sorted(want)


def test_fingerprints(spark):  # noqa: ANN001
    fields = "snapshot_no int, fingerprint string, chunk_id string, document_id long, heading_path array<string>, saved_at timestamp_ntz"
    rows = [
        (1, " FP_a", "c1", 1, ["x", "y"], T0), (2, "fp_a", "c9", 1, ["x", "y"], T0), (1, "fp_b", "c", 1, ["x", "y"], T0), (2, "fp_b", "c", 1, ["y", "x"], T0), (1, "fp_c", "c", 1, [], T0), (2, "fp_c", "c", 1, None, T0),
        (1, None, "c", 1, [], T0), (2, "fp_d", "c", None, [], T0), (2, "fp_d", "c", 2, [None], T0), (2, "fp_d", "c", 2, [None], T0),
    ]
    found = fingerprint_changes(spark.createDataFrame(rows, fields)).select(F.concat_ws(" ", "record_key", "change_kind")).collect()
    assert sorted(r[0] for r in found) == ["1/fp_b changed", "1/fp_c changed", "2/fp_d added"]


def test_repeated_keys_and_far_numbers(spark):  # noqa: ANN001
    """A key given twice in a snapshot counts once, numbers may be dates."""
    states = [(20250101, "a", 1), (20250101, "a", 2), (20250102, "a", 2), (20250102, "b", 1), (20250102, "b", 1)]
    found = snapshots.snapshot_changes(spark.createDataFrame(states, "snapshot_no int, record_key string, v int"), ["v"], [F.col("v")], lambda a, b: F.col(f"{a}.v") != F.col(f"{b}.v"))
    assert [tuple(r) for r in found.collect()] == [(20250102, "b", "added")]


def test_large_tables_are_divided(spark, monkeypatch):  # noqa: ANN001
    """All keys differ and share one bucket, which is divided until it decodes."""
    monkeypatch.setattr(snapshots, "MOST_CELLS", 8)
    states = [(n, f"k{n}-{i}", 1) for n in (1, 2) for i in range(300)]
    found = snapshots.snapshot_changes(spark.createDataFrame(states, "snapshot_no int, record_key string, v int"), ["v"], [F.col("v")], lambda a, b: F.lit(True), first_cells=2)
    assert found.groupBy("change_kind").count().orderBy("change_kind").collect() == [("added", 300), ("removed", 300)]

"""Staging and size-checked joins."""

from __future__ import annotations

import os

import pytest

from tidegrain import runtime


def test_bytes_are_checked(spark, monkeypatch):  # noqa: ANN001
    left = spark.createDataFrame([(i % 4, i) for i in range(40)], "k int, v int")
    right = spark.createDataFrame([(k, "x" * 5000, ["y" * 500]) for k in range(3)], "k int, text string, more array<string>")
    plan = lambda: runtime.join_small(left, right, ["k"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 12_000)
    assert "_salt" in plan()
    assert runtime.join_small(left, right, ["k"]).count() == 30
    assert runtime.broadcast_cost(left, 7) == (7, 7 * 32)


def test_staged_files_are_dropped(spark):  # noqa: ANN001
    with runtime.staging():
        kept = runtime.Staged(spark.range(3))
        assert kept.df.count() == 3
    assert not os.path.exists(kept.path.removeprefix("file:"))
    with pytest.raises(ValueError), runtime.staging():
        kept = runtime.Staged(spark.range(3))
        raise ValueError
    assert not os.path.exists(kept.path.removeprefix("file:"))

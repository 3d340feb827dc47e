"""Selection against sorting."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidegrain.llm import percentiles as P

T0 = datetime(2025, 1, 1)
FIELDS = "run_id string, started_at timestamp_ntz, completed_at timestamp_ntz, operation string, host string, latency_ms long, packet_bytes long, metric string, value string, n int, day string, g int"


def runs(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, "m", "v", 3, "d", 1) for r in rows], FIELDS)


def expected(values, percent):  # noqa: ANN001, ANN201
    return sorted(values)[max(1, -(-len(values) * percent // 100)) - 1]


@pytest.mark.parametrize("options", [{}, {"pivots": 1}, {"pivots": 7, "chunk_values": 200, "block": 100}])
def test_against_sorting(spark, options):  # noqa: ANN001
    """With several pivots, with one, and with groups split over partitions."""
    rng = random.Random(3)
    groups = {"big": [int(rng.lognormvariate(8, 2)) for _ in range(600)], "ties": [5] * 400 + [9], "one": [42], "two": [1, 2], "far": [0, 2**62, 2**62 + 1]}
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs]
    found = P.select(spark.createDataFrame(rows, "name string, value long, n long"), ["name"], **options).collect()
    assert sorted((r.name, r.percent, r.value, r.n) for r in found) == sorted((g, p, expected(v, p), len(v)) for g, v in groups.items() for p in P.PERCENTS)


def test_days_combine(spark):  # noqa: ANN001
    """Runs that come again on another day, later or earlier, count once."""
    rng = random.Random(5)
    rows = [(f"r{i % 250}", T0, T0 + timedelta(days=i % 3), "read", "H.example" if i % 2 else " h.example ", rng.randrange(9000), rng.randrange(99)) for i in range(300)]
    whole = P.percentiles(P.value_counts(P.unique_runs(runs(spark, rows))))
    days = [P.day_parts(runs(spark, rows[d::3])) for d in range(3)]
    assert sorted(whole.collect()) == sorted(P.percentiles(P.value_counts(P.combine([*days, days[1]]))).collect())
    assert sorted(whole.collect()) == sorted(P.percentiles(P.value_counts(P.combine([P.day_parts(runs(spark, rows))]))).collect())
    assert {r.host for r in whole.collect()} == {"", "h.example"}


def test_rows_that_do_not_count(spark):  # noqa: ANN001
    rows = [
        ("a", T0, T0, "read", "h", 10, 1), ("a", T0, T0 + timedelta(days=1), "read", "h", 20, 2), ("a", T0, T0 + timedelta(days=1), "read", "h", 20, 2),  # a later row, twice
        ("b", T0, None, "read", None, None, -5), ("c", T0, T0, None, " ", 0, None), (None, T0, T0, "read", "h", 7, 7), ("d", T0, T0, "", "h", -1, 2**62),
    ]
    found = {(r.scope, r.operation, r.host, r.metric, r.percent): (r.value, r.n) for r in P.percentiles(P.value_counts(P.unique_runs(runs(spark, rows)))).collect()}
    assert found[("operation", "read", "", "latency_ms", 50)] == (20, 1)
    assert found[("host", "", "h", "packet_bytes", 99)] == (2**62, 2)
    assert all(k[1] or k[2] for k in found)


def test_empty(spark):  # noqa: ANN001
    assert P.percentiles(P.value_counts(P.unique_runs(runs(spark, [])))).collect() == []


def test_rounding_bound(spark):  # noqa: ANN001
    from pyspark.sql import functions as F

    values = [0, 1, 255, 256, 257, 511, 513, 10**6 + 7, 2**40 + 12345, 2**62 + 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(P.rounded(F.col("v"), 8)).collect()]
    assert all(g <= v and v - g <= v * 2**-7 for v, g in zip(values, got, strict=True))

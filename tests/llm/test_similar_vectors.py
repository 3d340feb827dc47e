"""The forest against all pairs."""

from __future__ import annotations

import numpy as np

from tidegrain.llm import similar_vectors as V

FIELDS = "vec_id long, vector array<float>, class_id string, other string, similarity int"


def frame(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "o", 1) for i, v in rows], FIELDS)


def brute(rows, k=5, floor=0.8):  # noqa: ANN001, ANN201
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    out = set()
    for r in range(len(ids)):
        near = [c for c in np.lexsort((ids, -sims[r])) if c != r and sims[r][c] >= floor][:k]
        out |= {(int(min(ids[r], ids[c])), int(max(ids[r], ids[c]))) for c in near}
    return out


def test_recall(spark):  # noqa: ANN001
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    rows = [(i, centres[0 if i % 3 == 0 else i % 40] * rng.uniform(0.1, 9) + rng.standard_normal(64) * 0.25) for i in range(2000)]
    true = brute(rows)
    found = {tuple(r) for r in V.similar_pairs(frame(spark, rows), candidates=600, block=256).collect()}
    assert len(true & found) >= 0.9 * len(true)
    assert len(found & true) >= 0.9 * len(found)


def test_ties_and_copies(spark):  # noqa: ANN001
    """Of equals the smaller ids go first, however many copies there are."""
    base = np.arange(1, 65, dtype=float)
    rows = [(i, base * (1 + i % 2)) for i in range(100)] + [(200, base + np.eye(64)[0] * 40)]
    found = {tuple(r) for r in V.similar_pairs(frame(spark, rows)).collect()}
    assert found == brute(rows)
    near = V.neighbours(frame(spark, rows))
    assert near.groupBy("vec_id").count().where("count > 5").count() == 0


def test_unusable(spark):  # noqa: ANN001
    one = [1.0] * 64
    rows = [(1, one), (2, one), (2, one), (3, None), (4, []), (5, [0.0] * 64), (6, [1.0] * 63), (7, [*one[:63], float("nan")]), (8, [*one[:63], float("inf")]), (9, [*one[:63], None]), (None, one), (10, [-1.0] * 64)]
    assert {tuple(r) for r in V.similar_pairs(frame(spark, rows)).collect()} == {(1, 2)}
    assert V.similar_pairs(frame(spark, [])).collect() == []


def test_depths():
    """Against counting prefixes one by one."""
    rng = np.random.default_rng(1)
    hashes = np.sort(np.r_[rng.integers(0, 1 << V.BITS, 60), rng.integers(0, 1 << 12, 60), [5, 5, 5]])
    packed = V._depths(hashes, 7)
    for i, h in enumerate(hashes):
        shared = sorted((V.BITS - int(h ^ o).bit_length() for j, o in enumerate(hashes) if j != i), reverse=True)
        assert [(int(packed[i]) >> (6 * r)) & 63 for r in range(7)] == [shared[2**r - 1] for r in range(7)]


def test_one_large_class(spark):  # noqa: ANN001
    """Members of a class that is spread over tasks have the least members."""
    base = np.arange(1, 65, dtype=float)
    rows = [(i, base) for i in range(V.HOT_MEMBERS + 50)] + [(5000, base[::-1]), (5001, base[::-1])]
    near = {(r.vec_id, r["rank"]): r.other for r in V.neighbours(frame(spark, rows)).collect()}
    assert [near[(900, i)] for i in range(1, 6)] == [0, 1, 2, 3, 4]
    assert [near[(2, i)] for i in range(1, 6)] == [0, 1, 3, 4, 5]
    assert near[(5001, 1)] == 5000

"""Choices that depend on one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrain.operators import selection as S


def rows(frame):  # noqa: ANN001, ANN201
    return sorted(tuple(r) for r in frame.collect())


def test_stable_gate(spark):  # noqa: ANN001
    made = [(1, 1, False), (1, 2, False), (1, 3, True), (1, 4, True), (2, 1, True), (2, 2, False), (2, 3, True), (3, 1, False)]
    frame = spark.createDataFrame(made, "page int, rank int, stable boolean")
    assert rows(S.stable_gate(frame, "page", 2).select("page", "rank")) == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1)]


def test_partial_reuse(spark):  # noqa: ANN001
    made = [(1, 1, True, 9), (1, 2, False, 0), (1, 3, True, 1), (1, 4, True, 5), (2, 1, False, 0), (2, 2, True, 1), (2, 3, False, 0)]
    frame = spark.createDataFrame(made, "page int, rank int, stable boolean, stable_order long")
    assert rows(S.partly_reused(frame, "page", 3).select("page", "place", "rank")) == [(1, 1, 3), (1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


def test_compacted(spark):  # noqa: ANN001
    long = "the mills of the valley were repaired in spring and turn again"
    made = [(1, 1, long, ["a"], 0.7), (1, 2, long, ["a"], 0.7), (1, 3, long[:58], ["b"], 0.7), (1, 4, long[:50] + " but not for ever as we know by now", ["a"], 0.7), (1, 5, "weak", ["a"], 0.1), (1, 6, "other words", None, 0.5), (1, 7, " ", ["a"], 0.9), (2, 1, "weak", ["a"], 0.1)]
    frame = spark.createDataFrame(made, "page int, rank int, text string, heading_path array<string>, utility double")
    assert rows(S.compacted(frame, "page").select("page", "rank")) == [(1, 1), (1, 6), (2, 1)]
    assert S.compacted(frame.limit(0), "page").collect() == []


def test_patches(spark):  # noqa: ANN001
    chosen = spark.createDataFrame([(i, ["a", "b"], ["b"]) for i in range(7)], "id int, candidates array<string>, selected array<string>")
    bodies = ['{"selected": ["a"], "confidence": 0.9}', '{"selected": ["a"], "confidence": 0.5}', '{"selected": ["z"], "confidence": 1}', '{"selected": [], "confidence": 1}', "no json", '{"selected": ["a"]}']
    found = S.patched(chosen, spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).orderBy("id").collect()
    assert [r.outcome for r in found] == ["applied", "unsure", "unknown_candidate", "empty", "empty", "unsure", "none"] and [r.selected for r in found] == [["a"]] + [["b"]] * 6


def test_regressions_and_rewrites(spark):  # noqa: ANN001
    a, b = (spark.createDataFrame([("x", p, v), (only, 1.0, 1.0)], "host string, passed double, latency double") for p, v, only in ((0.9, 100.0, "old"), (0.8, 130.0, "new")))
    assert [(r.host, r.worse) for r in S.regressions(a, b, ["host"]).collect()] == [("x", ["pass_rate", "latency"])]
    made = spark.range(1).select(S.normalized_rewrites(F.lit("a  b\n\na b\nc\nd\ne")).alias("q")).first()
    assert made.q == ["a b", "c", "d"]


def test_digest_is_free_of_order(spark):  # noqa: ANN001
    frame = spark.createDataFrame([(i, [str(i)], None if i % 2 else {"k": i}) for i in range(50)], "a int, b array<string>, c map<string,int>")
    one, two = (S.digest(f, "t").first() for f in (frame, frame.orderBy(F.desc("a")).repartition(3)))
    assert one == two and one != S.digest(frame.where("a > 0"), "t").first()
    assert S.digest(frame.limit(0), "t").first().n == 0

"""Composed discovery on small tables."""

from __future__ import annotations

import pytest

from tidegrain.operators import discovery

GOALS = "query_id long, goal string"
FOUND = "query_id long, url string, label string, score double"


def scores(spark, rows, goals):  # noqa: ANN001, ANN201
    found = discovery.disambiguated(spark.createDataFrame(rows, FOUND), spark.createDataFrame(goals, GOALS))
    return {(r.query_id, r.url): r.disambiguated - r.score for r in found.collect()}


def test_families_are_told_apart(spark):  # noqa: ANN001
    near = [("http://mills.example/a", "water mills of the valley"), ("http://kilns.example/b", "lime kilns"), ("http://docs.mills.example/c", "mill wheels")]
    rows = [(1, u, label, 1.0 - i / 10) for i, (u, label) in enumerate(near)] + [(2, u, label, 3.0 - i) for i, (u, label) in enumerate(near)] + [(3, u, label, 1.0) for u, label in near[::2]] + [(4, u, label, 1.0) for u, label in near]
    more = scores(spark, rows, [(1, "Water mills of the valley"), (2, "water mills"), (3, "water mills"), (4, " ")])
    assert more[1, near[0][0]] > more[1, near[1][0]] >= 0
    assert more[1, near[0][0]] == pytest.approx(more[1, near[2][0]])  # one family
    assert {v for (q, _), v in more.items() if q > 1} == {0.0}  # clear lead, one family, no goal
    assert scores(spark, [], []) == {}


def test_literal_addresses(spark):  # noqa: ANN001
    text = "See http://a.mill.example/x/y/z. and (http://other.example/q), http://mill.example/pic.png; http://mill.example/b, http://mill.example/b"
    rows = [(1, "http://mill.example/", 0, text), (1, "http://mill.example/", 1, "http://mill.example/late http://mill.example/last"), (2, "http://mill.example/", 0, None), (3, None, 0, text)]
    found = discovery.literal_candidates(spark.createDataFrame(rows, "page_no long, url string, pos int, text string"))
    got = [(r.page_no, r.url) for r in found.orderBy("page_no", "rank").collect()]
    assert len(got) == 2 and {u for _, u in got} <= {"http://a.mill.example/x/y/z", "http://mill.example/b", "http://mill.example/late"}
    assert found.agg({"score": "min"}).first()[0] > 1.10


def test_composition(spark):  # noqa: ANN001
    fields = "query_id long, provider string, url string, label string, score double"
    rows = [(1, "memory", "http://mills.example/", "Water mills", 0.5), (1, "links", "http://mills.example/", "Mills", 0.7), (1, "links", "http://mills.example/deep/er/still", "x", 0.4), (1, "links", "http://kilns.example/", "Kilns", 0.6), (1, "memory", " ", "", 9.0)]
    found = discovery.web_discovery(spark.createDataFrame(rows, fields), spark.createDataFrame([(1, "water mills")], GOALS), 5).orderBy("rank").collect()
    assert [(r["rank"], r.url, r.providers) for r in found] == [(1, "http://mills.example/", ["links", "memory"]), (2, "http://kilns.example/", ["links"])]
    assert found[0].label == "Mills"

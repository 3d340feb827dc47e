"""Keyed tables, ranking, retrieval and graphs on small tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrain import runtime
from tidegrain.operators import analytics, discovery, graphs, keyed, ranking, retrieval

T0 = datetime(2025, 1, 1)


def rows(frame):  # noqa: ANN001, ANN201
    return sorted(tuple(r) for r in frame.collect())


def test_upsert_and_retention(spark):  # noqa: ANN001
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "y"), ("b", 3, "y"), ("c", None, "y")], "k string, at int, v string")
    assert rows(keyed.upsert(old, new, ["k"], ["at"])) == [("a", 1, "y"), ("b", 5, "x"), ("c", None, "y")]
    assert keyed.upsert(old.limit(0), new.limit(0), ["k"], ["at"]).collect() == []
    assert rows(keyed.retained(old, [F.desc("at")], 1)) == [("b", 5, "x")]
    assert keyed.pruned(old.unionByName(new), "at", F.lit(3)).count() == 3


def test_delta_and_merge(spark):  # noqa: ANN001
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["p", "q", "q", None], ["q", "r"]))
    assert {tuple(r) for r in keyed.delta(a, b, ["k"]).where("k IS NOT NULL").collect()} == {("p", "removed"), ("q", "retained"), ("r", "added")}
    c = spark.createDataFrame([("u", 0.5, " ", ["a"]), ("u", 0.9, None, ["b", "a"]), ("u", 0.1, "L", [])], "url string, score double, label string, reasons array<string>")
    merged = keyed.max_merge(c).first()
    assert (merged.score, merged.label, merged.reasons, merged.sources) == (0.9, "L", ["a", "b"], 3)


def test_pacing_is_the_recurrence(spark):  # noqa: ANN001
    rng = random.Random(1)
    asked = [(h, i, T0 + timedelta(seconds=rng.randrange(900))) for i in range(200) for h in [rng.choice("ab")]]
    found = analytics.paced(spark.createDataFrame(asked, "host string, id int, at timestamp_ntz"), "host", "at", "id", 7000)
    got = {r.id: r.waited_ms for r in found.collect()}
    for h in "ab":
        free = None
        for _, i, at in sorted((x for x in asked if x[0] == h), key=lambda x: (x[2], x[1])):
            start = at if free is None else max(at, free)
            assert got[i] == (start - at).total_seconds() * 1000
            free = start + timedelta(seconds=7)


def test_provider_health(spark):  # noqa: ANN001
    events = [("p", T0 + timedelta(minutes=i), f"r{i}", o) for i, o in enumerate(["success", "failure", "success", "timeout", "failure"])] + [("q", T0, "r", "blocked")]
    found = {r.provider: r for r in analytics.provider_health(spark.createDataFrame(events, "provider string, completed_at timestamp_ntz, run_id string, outcome string"), F.lit(T0 + timedelta(minutes=7)).cast("timestamp_ntz")).collect()}
    assert (found["p"].consecutive, found["p"].cooling, found["p"].health) == (2, True, 3 * 2 - 3 - 2 * 2 - 2 * 2 - 20)
    assert (found["q"].consecutive, found["q"].cooling, found["q"].health) == (1, True, -6 - 2 - 20)


RANKED = "page int, idx int, kind string, heading_path array<string>, text string, node_paths array<string>, alignment double, kind_match boolean, heading_backed boolean, embedded boolean, mean_depth double, score_ string"


def segment(idx, text, path=("A",), paths=1, kind="paragraph", page=1):  # noqa: ANN001, ANN201
    return (page, idx, kind, list(path), text, ["p"] * paths, 0.0, True, False, False, 3.0, "s")


def test_demotions(spark):  # noqa: ANN001
    anchor = segment(0, "This explains it at length, with more than one sentence. It says what the mills do, and it says why they do it; nothing is left out here at all.")
    index = segment(1, "\n".join(["Mills", "Canals", "Rivers", "Bridges", "Towns"]), paths=8, kind="list_item")
    code = segment(2, "run_all --fast\nset_mode X9", kind="code")
    fragment = segment(3, "A rather small piece below others that has between sixty and one hundred eighty characters", ("A", "B", "C"))
    menu = segment(4, "Home About Contact Docs Pricing", paths=5)
    found = {r.idx: r for r in ranking.ranked(spark.createDataFrame([anchor, index, code, fragment, menu], RANKED), "page").collect()}
    plain = {r.idx: r.score for r in ranking.scored(spark.createDataFrame([anchor, index, code, fragment, menu], RANKED), "page").collect()}
    assert found[0].rank == 1 and found[0].score == pytest.approx(plain[0])
    assert all(found[i].score < plain[i] - 0.1 for i in (1, 2, 3, 4))
    alone = ranking.ranked(spark.createDataFrame([fragment], RANKED), "page").first()
    assert alone.rank == 1 and ranking.ranked(spark.createDataFrame([], RANKED), "page").collect() == []


def test_deduplication_and_policy(spark):  # noqa: ANN001
    long = "the same text of forty bytes or more, to be sure of it"
    frame = spark.createDataFrame([(1, 1, long, True), (1, 2, long.upper(), False), (1, 3, long + " and some", False), (1, 4, "other", False), (2, 1, " ", False)], "page int, rank int, text string, stable boolean")
    assert rows(ranking.deduplicated(frame, "page").select("page", "rank")) == [(1, 2), (1, 4), (2, 1)]
    fields = "page int, rank int, text string, embedded boolean, heading_backed boolean, kind_match boolean, embedded_count int, heading_ratio double, short_text_ratio double"
    made = [(1, i, "t" * 50, i == 8, i == 9, True, 1, 0.2, 0.9) for i in range(1, 10)]
    chosen = [r[1] for r in rows(ranking.policy_selected(spark.createDataFrame(made, fields), "page", 3))]
    assert chosen == [1, 2, 9]  # the embedded row gives way again, as both act on the last


def test_novelty_and_outline(spark):  # noqa: ANN001
    frame = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5)], "page int, fingerprint string, score double")
    stable = spark.createDataFrame([(1, "a"), (1, "a")], "page int, fingerprint string")
    assert [(p, f, round(s, 2)) for p, f, s, _ in rows(ranking.novelty_biased(frame, stable, "page"))] == [(1, "a", 0.45), (1, "b", 0.55), (2, "a", 0.5)]
    paths = F.array(F.array(F.lit("A > B > C"), F.lit("C")), F.array(F.lit(" ")), F.array(F.lit("B > C")))
    assert spark.range(1).select(ranking.outline(paths).alias("o")).first().o == ["B > C"]


def test_most_similar_in_blocks(spark):  # noqa: ANN001
    rng = np.random.default_rng(2)
    data = [(i, rng.standard_normal(64).tolist()) for i in range(120)] + [(500, None), (501, [0.0] * 64), (502, [1.0])]
    frame = spark.createDataFrame(data, "vec_id long, vector array<float>")
    asked = frame.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    one, many = (rows(retrieval.most_similar(asked, frame, 3, block=b).select("query_id", "rank", "vec_id")) for b in (1000, 2))
    assert one == many and len(one) == 18 and all(v == q for q, k, v in one if k == 1)
    assert retrieval.most_similar(asked.limit(0), frame, 3).collect() == [] == retrieval.most_similar(asked, frame.limit(0), 3).collect()


def test_topics_and_ancestors(spark):  # noqa: ANN001
    fields = "host string, path string, url string, title string, summary string, observed_at timestamp_ntz, vector array<float>, stable_ratio double, novelty_ratio double"
    one = lambda p, v, d=1: ("h", p, f"u{p}", f"t{p}", "s", T0 + timedelta(days=d), [v] * 64, 0.5, float("nan"))
    documents = spark.createDataFrame([one("/a/b", 1.0), one("/a/b/c", 3.0, 9), one("/a/b/d", 5.0), one("/x", 1.0), (None, *one("/a/b", 1.0)[1:])], fields)
    top = {r.root_path: r for r in retrieval.topics(documents).collect()}
    assert set(top) == {"/a/b", "/a/b/c", "/a/b/d"} and top["/a/b"].representative_url == "u/a/b" and top["/a/b"].support_count == 3 and top["/a/b"].observed_at == T0 + timedelta(days=9)
    assert top["/a/b"].vector[0] == pytest.approx((2.0 * 1 + 3 + 5) / 4)
    assert retrieval.topics(documents.limit(0)).collect() == []
    hits = spark.createDataFrame([(7, "h", "/a/b/c")], "query_id long, host string, path string")
    assert [r.url for r in retrieval.ancestor_roots(hits, documents.where("host IS NOT NULL"), F.lit(T0), 5).collect()] == ["u/a/b"]
    assert {r.summary for r in retrieval.topic_summaries(documents).where("root_path = '/a/b/c'").collect()} == {"t/a/b/c s"}


def test_neighbours(spark):  # noqa: ANN001
    edges = spark.createDataFrame([("u", f"t{i}", i == 2, T0 + timedelta(days=i)) for i in range(4)], "url string, target string, same_host boolean, observed_at timestamp_ntz")
    found = retrieval.neighbours(spark.createDataFrame([(1, "u"), (2, "v")], "query_id long, url string"), edges, 2)
    assert [(r.target, r.score) for r in found.orderBy("rank").collect()] == [("t2", pytest.approx(0.9)), ("t3", pytest.approx(0.7))]


def test_components_of_long_paths(spark):  # noqa: ANN001
    ids = list(range(200))
    random.Random(3).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[i], ids[i + 1]) for i in range(100, 199)] + [(ids[5], ids[5]), (None, 3)]
    found = dict(rows(graphs.components(spark.createDataFrame(edges, "a long, b long"))))
    assert {found[i] for i in ids[:100]} == {min(ids[:100])} and {found[i] for i in ids[100:]} == {min(ids[100:])}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_reach_and_expansion(spark):  # noqa: ANN001
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("c", "a", 4), ("x", "a", 3)], "from_place string, to_place string, count long")
    seeds = spark.createDataFrame([("a",)], "place string")
    assert rows(graphs.reached(edges, seeds, 3)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert [(r.place, r.score) for r in graphs.expanded(edges, seeds, 5).collect()] == [("b", 2.0), ("c", 2.0), ("x", 1.5)]


def test_families(spark):  # noqa: ANN001
    c = spark.createDataFrame([("u1", "h", "f", 0, 0.5), ("u2", "h", "f", 2, 0.6), ("u3", "g", "f", 0, 0.5), ("u4", "g", "f", 3, 2.0), ("u5", "k", "e", 1, 0.1)], "url string, host string, family string, depth int, score double")
    boosted = {r.url: round(r.boosted - r.score, 2) for r in discovery.shallow_preferred(c).collect()}
    assert boosted == {"u1": 0.28, "u2": 0.0, "u3": 0.18, "u4": 0.0, "u5": 0.0}
    assert [(r.family, r.url) for r in discovery.first_per_family(c, 1).collect()] == [("f", "u4")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_same(spark, how):  # noqa: ANN001
    left = spark.createDataFrame([(i % 7, i) for i in range(100)] + [(None, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "d")], "k int, w string")
    side = right if how in ("inner", "left") else right.select("k").distinct()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, runtime.join_small(left, side, ["k"], how, limit=0).collect())) == sorted(map(key, left.join(side, "k", how).collect()))


def test_staged_tables(spark):  # noqa: ANN001
    staged = runtime.Staged(spark.range(5))
    assert staged.df.count() == 5 and staged.path.startswith(runtime.shared_dir(spark))
    staged.drop()


@pytest.mark.parametrize(("named", "context", "master", "want"), [("file:///shared/", None, "spark://x", "file:///shared"), (None, "hdfs:///c/1", "spark://x", "hdfs:///c/1"), (None, None, "spark://x", None), (None, None, "local-cluster[2,1,1024]", None)])
def test_shared_folder(named, context, master, want):  # noqa: ANN001
    """As the session names it; on a cluster never one of its own."""
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(getCheckpointDir=lambda: context, master=master))
    if want is None:
        with pytest.raises(ValueError, match="checkpoint"):
            runtime.shared_dir(session)
    else:
        assert runtime.shared_dir(session) == want

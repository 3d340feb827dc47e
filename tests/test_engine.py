"""Commands end to end on a small site, and the sources."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegrain import engine
from tidegrain.sources import interchange, search, settings

PAGES = [
    (1, "http://a.example/", "<title>Home</title><h1>Mills</h1><p>All about the mills of the valley, told at some length here.</p><a href='/water'>water mills</a><a href='/wind'>wind</a><a href='http://b.example/'>b</a>"),
    (2, "http://a.example/water", "<title>Water</title><h1>Water mills</h1><p>Water mills turn by the river. They grind all the corn of the valley in spring.</p><p>They are old.</p><a href='/deep'>deep</a><a href='/'>home</a>"),
    (3, "http://a.example/deep", "<title>Deep</title><p>Far below.</p><a href='/wind'>w</a>"), (3, "http://a.example/deep", "<title>Deep</title><p>Far below.</p><a href='/wind'>w</a>"), (4, "http://b.example/", "<p>Elsewhere.</p>"), (5, "http://a.example/none", None),
]


@pytest.fixture(scope="module")
def site(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(PAGES, "page_no long, url string, html string")


def test_read_and_proof(spark, site):  # noqa: ANN001
    made = engine.read(site).collect()
    assert sorted(r.page_no for r in made) == [1, 2, 3, 4]
    two = next(r for r in made if r.page_no == 2)
    assert two.outline == ["Water mills"] and two.chunk_count == 1 and two.summary.startswith("Water mills turn")
    assert two.packet_bytes == len(two.chunks[0].text) == two.chunks[0].proof.end
    found = engine.proof(engine.read(site), two.chunks[0].proof.proof_id).collect()
    assert [r.page_no for r in found] == [2] == [r.page_no for r in engine.proof(engine.read(site), two.chunks[0].chunk_id).collect()]
    again = engine.read(site.orderBy(F.desc("page_no"))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, made))
    assert engine.read(site.limit(0)).collect() == []


def test_objective_and_profiles(spark, site):  # noqa: ANN001
    plain, aimed = (next(r for r in engine.read(site, objective=o).collect() if r.page_no == 2) for o in (None, "water mills turn by the river"))
    assert aimed.chunks[0].score >= plain.chunks[0].score and engine.read(site, "tiny").count() == engine.read(site, "deep").count() == 4


def test_discover_query_crawl(spark, site):  # noqa: ANN001
    goals = spark.createDataFrame([(9, "water mills", "http://a.example/"), (10, "x", "http://unknown.example/")], "query_id long, goal string, seed_url string")
    assert engine.discover(site, goals).where("rank = 1").first().url == "http://a.example/water"
    assert [(r.query_id, r.page_no) for r in engine.query(site, goals).collect()] == [(9, 2)]
    seeds = spark.createDataFrame([("http://a.example/",), ("http://none.example/",)], "seed string")
    assert sorted((r.url, r.depth) for r in engine.crawl(site, seeds).collect()) == [("http://a.example/", 0), ("http://a.example/deep", 2), ("http://a.example/water", 1)]
    assert engine.crawl(site, seeds, settings.Settings(max_pages=1)).count() == 1


def test_memory(spark, site):  # noqa: ANN001
    rows = engine.observe(engine.read(site), F.lit(datetime(2025, 1, 1)))
    later = engine.observe(engine.read(site.where("page_no = 2")), F.lit(datetime(2025, 2, 1)))
    kept = engine.remember(rows, later)
    assert kept.count() == 4 and kept.where("url LIKE '%water'").first().observed_at == datetime(2025, 2, 1)
    assert engine.prune(kept, "observed_at", F.lit(datetime(2025, 1, 15))).count() == 1


def test_align(spark):  # noqa: ANN001
    goal = spark.createDataFrame([(1, "water mills"), (2, "zzz")], "query_id int, text string")
    candidates = spark.createDataFrame([(1, "a", "water mills"), (1, "b", "plain fields"), (2, "c", "qqq"), (2, "d", "qqq")], "query_id int, id string, text string")
    assert [(r.id, r.stands_out) for r in engine.align(goal, candidates).orderBy("query_id").collect()][0] == ("a", True)
    assert engine.align(goal, candidates).where("query_id = 2").first().stands_out is False


def test_search_sources(spark):  # noqa: ANN001
    page = '<a class="result__a" href="//s.example/l/?uddg=http%3A%2F%2Fx.example%2Fp%3Fa%3D1">X <b>one</b></a><a class="result__a" href="/own">own</a><a href="http://y.example/">not a result</a><a href="/l/?uddg=ftp%3A%2F%2Fz">f</a><a class="result__a" href="http://x.example/p?a=1">again</a>'
    frame = spark.createDataFrame([(1, "http://s.example/?q=1", page)], "page_no long, url string, html string")
    assert [(r.target, r.label) for r in search.result_pages(frame).collect()] == [("http://x.example/p?a=1", "X one")]
    answers = spark.createDataFrame([(1, '{"web": {"results": [{"url": "u1", "title": "t"}, {"url": " "}, {"url": "u2"}]}}'), (2, "broken"), (3, None)], "query_id int, body string")
    assert [(r.query_id, r.rank, r.url) for r in search.api_results(answers).collect()] == [(1, 1, "u1"), (1, 3, "u2")]
    one = spark.range(1).select(search.provider_list(F.lit("b, a\n b,,c")).alias("p"), search.provider_name(F.lit("https://S.example/x")).alias("n"), search.search_address(F.lit("http://s/?a=1"), F.lit("x y")).alias("u"), search.retry_profile(F.lit("odd")).alias("r"), search.fetch_profile(F.lit(None).cast("string")).alias("f")).first()
    assert tuple(one) == (["b", "a", "c"], "s.example", "http://s/?a=1&q=x+y", "none", "browser_like")


def test_interchange(spark, tmp_path):  # noqa: ANN001
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "k string, at int, trace_id string")
    interchange.export_lines(rows, f"{tmp_path}/lines", [F.col("k")])
    with open(f"{tmp_path}/lines/part-broken.json", "w") as f:
        f.write('{"k": "c", "at": "no number"}\n')
    back = interchange.import_lines(spark, f"{tmp_path}/lines", rows.schema, spark.createDataFrame([("a", 0, "old")], rows.schema), ["k"], ["at"])
    assert sorted(map(tuple, back.collect())) == [("a", 1, "x"), ("b", 2, None)]
    interchange.save_by_trace(rows, f"{tmp_path}/traces")
    assert [tuple(r) for r in interchange.load_trace(spark, f"{tmp_path}/traces", "x").collect()] == [("a", 1, "x")]
    with open(f"{tmp_path}/cases.json", "w") as f:
        f.write('{"version": "1", "cases": [{"id": "c1"}, {"id": "c2"}]}')
    assert [r.id for r in interchange.read_cases(spark, f"{tmp_path}/cases.json").collect()] == ["c1", "c2"]


def test_bundle(spark, tmp_path):  # noqa: ANN001
    runs = spark.read.parquet("/root/testdata/sf0.001/analytics_runs.parquet")
    interchange.export_bundle(runs, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/runs").count() == runs.count() and spark.read.json(f"{tmp_path}/value_report").first().total_runs == runs.count()


def test_settings(tmp_path):  # noqa: ANN001
    (tmp_path / "s.json").write_text('{"max_pages": 7, "profile": "tiny", "unknown": 1}')
    made = settings.load(str(tmp_path / "s.json"), {"TIDEGRAIN_MAX_PAGES": "9"})
    assert (made.max_pages, made.profile, made.max_depth) == (9, "tiny", 2)
    for bad in ({"TIDEGRAIN_MAX_PAGES": "-1"}, {"TIDEGRAIN_PROFILE": "odd"}, {"TIDEGRAIN_MIN_SCORE": "x"}):
        with pytest.raises(ValueError):
            settings.load(None, bad)

"""Column functions on single values."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegrain.functions import text as T
from tidegrain.functions import urls as U
from tidegrain.functions import values as V
from tidegrain.functions import vectors as X


def value(spark, column):  # noqa: ANN001, ANN201
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):  # noqa: ANN001, ANN201
    return F.lit(x)


@pytest.mark.parametrize(("made", "want"), [
    (lambda: T.one_line(lit(" a\t b\xa0")), "a b"), (lambda: T.fields(lit("")), []), (lambda: T.marks(lit("a. b! ü;")), 3), (lambda: T.sentences(lit("A b.  C!? ")), ["A b", "C"]), (lambda: T.lines(lit(" a \n\n b")), ["a", "b"]),
    (lambda: T.alnum_only(lit("Ä-b C1")), "b c1"), (lambda: T.shortest(lit("the cat of the house sat on a red mat today. Next")), "cat house sat red mat today"), (lambda: T.shortest(lit("...")), "..."), (lambda: T.head(lit("one two three"), 8), "one two"), (lambda: T.head(lit("one"), 8), "one"),
    (lambda: T.display(lit("a​ ,b\x07  c")), "a,b c"), (lambda: T.looks_like_junk(lit("x { y")), True), (lambda: T.looks_like_junk(lit("plain")), False), (lambda: T.title_like_share(lit("A Big (Cat) x1 Z9")), 0.6), (lambda: T.identifier_line(lit("a_b C9 plain")), True), (lambda: T.symbolic_line(lit("x = y")), True), (lambda: T.symbolic_line(lit("plain text.")), False),
    (lambda: T.covered(lit("The red-mill stands"), F.array(lit("red mill"), lit("mil"))), ["red mill"]), (lambda: T.mean_length(F.array().cast("array<string>")), 0.0), (lambda: T.one_line(lit(None).cast("string")), None),
])
def test_text(spark, made, want):  # noqa: ANN001
    got = value(spark, made())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(("url", "host", "path", "depth"), [("HTTP://User@A.Example:80/x//y/?q#f", "a.example", "/x//y/", 2), ("https://b.example", "b.example", "/", 0), ("nonsense", None, "/", 0)])
def test_urls(spark, url, host, path, depth):  # noqa: ANN001
    u = lit(url)
    got = spark.range(1).select(U.host(u).alias("h"), U.path(u).alias("p"), U.depth(U.path(u)).alias("d")).first()
    assert (got.h, got.p, got.d) == (host, path, depth)


@pytest.mark.parametrize(("url", "boost"), [("http://a.b/", 0.22), ("http://a.b/#x", 0.12), ("http://a.b/x", 0.19), ("http://a.b/x/y?q", 0.08), ("http://a.b/1/y/z", -0.09), ("http://a.b/tag-x", 0.09), ("http://a.b/a-long-slug-of-words/x.htm", 0.08 + 0.03 - 0.08 - 0.04)])
def test_structure(spark, url, boost):  # noqa: ANN001
    assert value(spark, U.structure_boost(lit(url))) == pytest.approx(boost)


def test_more_urls(spark):  # noqa: ANN001
    assert value(spark, U.ancestors(lit("/a/b/"))) == ["/a", "/a/b"] and value(spark, U.ancestors(lit("/"))) == []
    assert value(spark, U.family(lit("x.y.example"))) == "y.example" and value(spark, U.family(lit("h"))) == "h"
    assert value(spark, U.resource_class(lit("/a.PDF"))) == "document_file" and value(spark, U.resource_class(lit("/a.b/c"))) == "html_like" and value(spark, U.resource_class(lit("/a.bin"))) == "unknown"
    assert value(spark, U.canonical(lit("HTTPS://www.A.example/x/?q"))) == "a.example/x"
    assert value(spark, U.hinted(lit("x.a.example"), F.array(lit("a.example")))) and not value(spark, U.hinted(lit("xa.example"), F.array(lit("a.example"))))


def test_values(spark):  # noqa: ANN001
    assert value(spark, V.lenient_int(lit(" 12ab"))) == 12 and value(spark, V.lenient_int(lit("x"))) == 0
    assert value(spark, V.first_filled(lit(" "), lit(None).cast("string"), lit(" b "))) == "b"
    assert value(spark, V.ratio(lit(1), lit(0))) == 0.0 and value(spark, V.clamp(lit(7.0))) == 1.0
    now = lit(datetime(2025, 1, 31))
    assert [value(spark, V.recency(lit(datetime(2025, 1, d)), now)) for d in (30, 24, 2, 1)] == [0.12, 0.08, 0.04, 0.04]
    assert value(spark, V.content_id("x", lit("a"), lit(None).cast("string"))).startswith("x_") and len(value(spark, V.piped_id("m", lit(" a ")))) == 18
    merged = V.merged_map(F.create_map(lit("a"), lit("1"), lit("b"), lit("2")), F.create_map(lit("a"), lit(" "), lit("b"), lit("3")))
    assert value(spark, merged) == {"a": "1", "b": "3"}


def test_vectors(spark):  # noqa: ANN001
    arr = lambda *x: F.array(*(lit(float(v)) for v in x))
    assert value(spark, X.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(2**-0.5)
    assert [value(spark, X.cosine(arr(1, 0), b)) for b in (arr(0, 0), arr(1), F.array().cast("array<double>"), lit(None).cast("array<double>"), arr(float("nan"), 1))] == [0.0] * 5
    rows = spark.createDataFrame([("a b a",), (None,), ("",)], "t string").select(X.embed("t").alias("v")).collect()
    assert max(rows[0].v) == 2.0 and sum(rows[0].v) == 3.0 and rows[1].v is None and sum(rows[2].v) == 0.0


def test_families(spark):  # noqa: ANN001
    """Public suffixes of one and of two labels, and those given."""
    from tidegrain.functions import urls

    hosts = {"www.mill.co.uk": "mill.co.uk", "a.b.mill.com.br": "mill.com.br", "co.uk": "co.uk", "docs.mill.example": "mill.example", "mill.example": "mill.example", "localhost": "localhost", "x.co.museum": "co.museum", "a.pages.dev": "a.pages.dev", "w.a.pages.dev": "a.pages.dev"}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls.family(F.col("h"), ("pages.dev",)).alias("f"))
    assert {r.h: r.f for r in rows.collect()} == hosts

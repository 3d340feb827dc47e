"""The parser and what is read from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

import pytest

from tidegrain.operators import pages as P
from tidegrain.sources import html as H

PAGE = """<!doctype html><HTML><head><title> A &amp; B </title></head><body>
<nav><ul><li>Home</li></ul></nav><div class="site-header"><p>gone</p></div><div hidden><p>gone</p></div><p aria-hidden="TRUE">gone</p>
<main><h1>Top</h1><p>One <b>bold</b> &lt;x&gt;<p>Two <span>words</span> here<ul><li>a<li>b <ul><li>c</ul></ul>
<blockquote>said</blockquote><pre>x = 1
y</pre><table><tr><th>k<td>v<tr><td>w</table><p id="related">kept</p></main><footer><p>gone</p></footer>"""


def texts(page, profile="standard"):  # noqa: ANN001, ANN201
    return [(n[0].rsplit("/", 1)[-1], n[2], n[3]) for n in H.reduced(H.parse(page), profile)]


def test_reduction_rules():
    found = texts(PAGE)
    assert [t for _, _, t in found] == ["Top", "One bold <x>", "Two words here", "a", "b c", "c", "said", "x = 1 y", "k", "v", "w", "kept"]
    assert [k for _, k, _ in found[:2]] == ["heading", "paragraph"]
    assert found[-1][0] == "p[3]"  # counts siblings that are left
    assert "kept" not in [t for _, _, t in texts(PAGE, "aggressive")]
    assert H.title(H.parse(PAGE)) == "A & B"
    assert "Home" in [n[3] for n in H.text_nodes(H.parse(PAGE), None)]


@pytest.mark.parametrize(("page", "want"), [
    ("", []), ("plain", []), ("<p>a<div>b<p>c</div>", ["a", "c"]), ("</p></div><p>a</b>", ["a"]), ("<p>a<br>b<img src=x>c", ["a b c"]), ("<p>1 < 2 and <% x %>", ["1 < 2 and <% x %>"]), ("<P CLASS=x>A</P><script>var p='<p>no</p>'</script>", ["A"]),
    ("<!-- <p>no</p> --><p>a", ["a"]), ("<p>" * 300 + "deep", ["deep"]), ("<li>a<p>b", ["a b", "b"]),
])
def test_malformed(page, want):  # noqa: ANN001
    assert [n[3] for n in H.text_nodes(H.parse(page))] == want


def test_payload_of_scripts():
    page = '<body><script>window.__NEXT_DATA__ = {"title":"A long enough \\"title\\" of a page here","name":"short","description":"An &lt;b&gt;described&lt;/b&gt; thing that is long enough"}</script></body>'
    assert [n[3] for n in H.reduced(H.parse(page))] == ["An described thing that is long enough", 'A long enough "title" of a page here']
    assert H.reduced(H.parse("<p>a</p><p>b</p>" + page))[-1][3] == "b"  # only where nodes lack


def test_links_and_identities():
    page = '<head><link rel="canonical" href="/c"><meta property="og:url" content="http://o.example/"></head><a href="/x">One <b>two</b></a><a href="/x">again</a><a href="mailto:a@b">m</a><a href="http://other.example/y#z">o</a><A HREF=\'z\'>q</A><a>none</a>'
    root = H.parse(page)
    assert H.links(root, "http://s.example/d/e") == [("http://s.example/x", "One two"), ("http://other.example/y#z", "o"), ("http://s.example/d/z", "q")]
    assert [u for u, _ in H.links(root, "http://s.example/d/e", True)] == ["http://s.example/x", "http://s.example/d/z"]
    assert H.identity_references(root, "http://s.example/d") == [("canonical", "http://s.example/c"), ("og_url", "http://o.example/")]


def test_segments_fold():
    n = lambda kind, text, level=0: ("/p", "p", kind, text, 2, level)
    found = P.fold([n("paragraph", "a"), n("heading", "H1", 1), n("paragraph", "b"), n("paragraph", "c"), n("heading", "H3", 3), n("list_item", "d"), n("heading", "H2", 2), n("paragraph", "ü" * 599), n("paragraph", "x"), n("paragraph", "y")], "T")
    assert [(s["heading_path"], s["text"][:1], len(s["node_paths"])) for s in found] == [(["T"], "a", 1), (["H1"], "b", 2), (["H1", "H3"], "d", 1), (["H1", "H2"], "ü", 1), (["H1", "H2"], "x", 2)]  # the cap is in bytes


def test_tables(spark):  # noqa: ANN001
    rows = [(1, "http://a.example/x", PAGE, 5), (2, None, None, 5), (None, "u", PAGE, 5), (3, None, "", 5), (4, "u", "<title>Only</title>", 5)]
    frame = spark.createDataFrame(rows, "page_no long, url string, html string, pos int")
    assert {r.page_no for r in P.nodes(frame).collect()} == {1}
    assert {(r.page_no, r.text) for r in P.segments(frame).where("page_no = 4").collect()} == {(4, "Only")}
    assert P.nodes(frame.limit(0)).collect() == [] == P.page_links(frame.limit(0)).collect()
    one = P.signals(P.nodes(frame)).collect()[0]
    assert one.node_count == 12 and abs(one.heading_ratio - 1 / 12) < 1e-9


def test_pages_that_are_not_html(spark):  # noqa: ANN001
    """Text by blank lines, code by lines, by content type and extension."""
    from tidegrain.operators import packets, pages

    code = "\n".join(f"line_{i} = {i}" for i in range(70))
    rows = [
        (1, "http://a.example/notes.txt", "One  para.\n\n\n\nTwo <b>stays</b>.", "text/plain"), (2, "http://a.example/src/x.py?raw=1", code, "text/plain; charset=utf-8"), (3, "http://a.example/", "  ", "text/plain"),
        (4, "http://a.example/p", "<title>T</title><p>Shown here.</p>", None), (5, "http://a.example/q", "<p>Shown.</p>", "application/xhtml+xml"),
    ]
    raw = spark.createDataFrame(rows, "page_no long, url string, html string, content_type string")
    found = {(r.page_no, r.pos): (r.path, r.kind, r.text) for r in pages.nodes(raw).collect()}
    assert found[1, 0] == ("/p[1]", "paragraph", "One para.") and found[1, 1] == ("/p[2]", "paragraph", "Two <b>stays</b>.")
    assert [found[2, i][2].count("\n") for i in range(3)] == [31, 31, 5] and found[2, 2][:2] == ("/pre[3]", "code")
    assert found[4, 0][2] == "Shown here." and (3, 0) not in found
    assert {r.page_no: r.title for r in packets.packets(raw).collect()} == {1: "notes.txt", 2: "x.py", 3: "a.example", 4: "T", 5: ""}
    assert [r[0] for r in raw.select(pages.substrate(F.col("html"), F.col("content_type"))).collect()] == ["plain_text"] * 3 + ["generic_content"] * 2


def test_payload_is_kept_in_packets(spark):  # noqa: ANN001
    """The selection of a page with payload has one of its rows."""
    from tidegrain.operators import ranking

    rows = [(1, i, f"text {i} " * 9, i == 9, False, True, 1, 0.0, 0.0) for i in range(1, 10)]
    ranked = spark.createDataFrame(rows, "page_no long, rank int, text string, embedded boolean, heading_backed boolean, kind_match boolean, embedded_count long, heading_ratio double, short_text_ratio double")
    assert sorted(r["rank"] for r in ranking.policy_selected(ranked, "page_no", 4).collect()) == [1, 2, 3, 9]

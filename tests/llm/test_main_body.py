"""Main bodies of small sites."""

from __future__ import annotations

from tidegrain.llm import main_body as M

FIELDS = "page_no long, url string, pos int, path string, tag string, kind string, text string, heading_level int, host string, importance double"


def site(pages=12):  # noqa: ANN001, ANN201
    rows = []
    for p in range(pages):
        nodes = [("/html[1]/body[1]/div[1]/ul[1]/li[1]", "li", "Home"), ("/html[1]/body[1]/div[1]/ul[1]/li[2]", "li", f"Own {p}"), ("/html[1]/body[1]/div[2]/h1[1]", "h1", f"Title {chr(97 + p)}"), ("/html[1]/body[1]/div[2]/p[1]", "p", f"Some real words about {'x' * (p + 1)} here."),
                 ("/html[1]/body[1]/div[2]/p[2]", "p", "Follow us for more"), ("/html[1]/body[1]/div[2]/pre[1]", "pre", "print(1)"), ("/html[1]/body[1]/div[3]/p[1]", "p", "© 2024 Site")]
        rows += [(p, "http://site.example/" + "a" * (p + 1), i, path, tag, None, text, 1 if tag == "h1" else 0, "h", 0.5) for i, (path, tag, text) in enumerate(nodes)]
    return rows


def test_site(spark):  # noqa: ANN001
    frame = spark.createDataFrame(site() + site()[:9], FIELDS)  # some nodes delivered twice
    found = {tuple(r) for r in M.not_main_body(frame).collect()}
    assert found == {(p, i) for p in range(12) for i in (0, 1, 4, 6)}
    texts = {r.page_no: r.text for r in M.main_texts(frame).collect()}
    assert texts[0] == "Title a\nSome real words about x here.\nprint(1)"


def test_odd_rows(spark):  # noqa: ANN001
    rows = [(1, None, 0, None, None, None, None, None, None, None), (None, "u", 0, "/p", "p", "k", "t", 0, None, None), (2, "u", None, "/p", "p", "k", "t", 0, None, None), (3, "u", 0, "/html[1]/body[1]/p[1]", "p", "k", "long " * 50_000, 0, None, None)]
    assert M.not_main_body(spark.createDataFrame(rows, FIELDS)).collect() == []
    assert M.not_main_body(spark.createDataFrame([], FIELDS)).collect() == []
    assert M.main_texts(spark.createDataFrame([], FIELDS)).collect() == []


def changed(rows, path):  # noqa: ANN001, ANN201
    """The same pages with other paths."""
    return [(*r[:3], path(r[3], r[4]), *r[4:]) for r in rows]


def test_wrapped(spark):  # noqa: ANN001
    """One wrapper around everything, or around the article only, is no branch."""
    whole = changed(site(), lambda p, _: p.replace("/body[1]/", "/body[1]/div[1]/section[1]/"))
    article = changed(site(), lambda p, _: p.replace("/div[2]/", "/div[2]/div[1]/"))
    for rows in (whole, article):
        assert {tuple(r) for r in M.not_main_body(spark.createDataFrame(rows, FIELDS)).collect()} == {(p, i) for p in range(12) for i in (0, 1, 4, 6)}


def test_without_page_heading(spark):  # noqa: ANN001
    """Importance decides; a page heading in a header is no article."""
    none = [(*r[:4], "h2" if r[4] == "h1" else r[4], *r[5:7], 0, *r[8:]) for r in site()]
    assert {tuple(r) for r in M.not_main_body(spark.createDataFrame(none, FIELDS)).collect()} == {(p, i) for p in range(12) for i in (0, 1, 4, 6)}
    header = changed(site(), lambda p, tag: "/html[1]/body[1]/header[1]/h1[1]" if tag == "h1" else p)
    header = [(*r[:6], r[6] + " and a few more words so that the text is long enough", *r[7:]) if r[2] == 3 else r for r in header]
    found = {tuple(r) for r in M.not_main_body(spark.createDataFrame(header, FIELDS)).collect()}
    assert {(p, i) for p, i in found if i in (3, 5)} == set()


def test_section_of_teasers(spark):  # noqa: ANN001
    """A section under a heading that recurs is cut, though its texts differ."""
    rows = site()
    for p in range(12):
        for i, (tag, text) in enumerate([("h3", "Most read"), ("p", f"Another story of number {'y' * (p + 1)} to read at once."), ("p", f"One more about {'z' * (p + 1)} for later.")]):
            rows.append((p, "http://site.example/" + "a" * (p + 1), 10 + i, f"/html[1]/body[1]/div[2]/div[1]/{tag}[{i + 1}]", tag, None, text, 3 if tag == "h3" else 0, "h", 0.5))
    found = {tuple(r) for r in M.not_main_body(spark.createDataFrame(rows, FIELDS)).collect()}
    assert found == {(p, i) for p in range(12) for i in (0, 1, 4, 6, 10, 11, 12)}


def test_from_pages(spark):  # noqa: ANN001
    html = "<body><div><ul><li>Home</li></ul></div><div><h1>Title {0}</h1><p>Some real words about {1} here.</p></div><div><p>© Site</p></div></body>"
    pages = [(p, f"http://site.example/{p}", html.format(chr(97 + p), "x" * (p + 1))) for p in range(12)] + [(50, "u", None), (None, "u", "<p>x</p>")]
    nodes = M.page_nodes(spark.createDataFrame(pages, "page_no long, url string, html string"))
    texts = {r.page_no: r.text for r in M.main_texts(nodes).collect()}
    assert len(texts) == 12 and texts[0] == "Title a\nSome real words about x here."

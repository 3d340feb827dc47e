"""Residue rules on pages and titles."""

from __future__ import annotations

import pytest

from tidegrain.llm import residue as R

ARTICLE = "<article><h1>On mills</h1><p>The mills of the valley were repaired in spring. They turn again.</p>{}</article>"


def frame(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, 200, "k", "f") for r in rows], "page_no long, url string, html string, status_code int, key string, found string")


def found(spark, rows):  # noqa: ANN001, ANN201
    return sorted(r.page_no for r in R.residue_pages(frame(spark, rows)).collect())


@pytest.mark.parametrize("title", ["404 Not Found", "{{title}} | Site", "Lorem ipsum dolor sit", "Seite nicht gefunden - Mills", "Access denied | Mills", "undefined | Mills", "[Insert title here]", "Please enable JavaScript", "Hello {first_name}, welcome", "Page introuvable"])
def test_titles_that_are(title):  # noqa: ANN001
    assert R.title_case(title, frozenset())


@pytest.mark.parametrize("title", ["How double braces work in templates", "Access denied by design: permissions in Mills", "Lost and not found: the archive", "Route 404, the coastal road", "A history of filler text in print", "Error budgets at Mills, year 5", "Pages public | Kaslarix"])
def test_titles_that_are_not(title):  # noqa: ANN001
    assert not R.title_case(title, frozenset())


@pytest.mark.parametrize("body", [
    "<h1>Oops</h1><p>The page you are looking for could not be found.</p>", "<noscript>You need to enable JavaScript to run this app.</noscript><div id=root></div>", "<center><h2>503</h2>The service is temporarily unavailable, please retry in 37 minutes.<hr>x/1</center>",
    "<h1>Mills</h1><p>Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.</p>", ARTICLE.format("<p>{city_name}</p>"), ARTICLE.format("<p>It was __PRICE__ then.</p>"), "<h1><%= @heading %></h1><p>Text.",
    "<P>Sie haben keine Berechtigung für diese Seite.<P>Impressum", "<p>Verify that you are human to continue.</p>",
])
def test_pages_that_are(spark, body):  # noqa: ANN001
    """A single page: by its placeholders, or by phrases alone."""
    assert found(spark, [(1, "http://a.example/", f"<html><title>x</title><body>{body}</body></html>")]) == [1]


@pytest.mark.parametrize("body", [
    ARTICLE.format(""), ARTICLE.format("<p>A reply of 404 tells Mills that the page could not be found or the service is down. So we wait.</p>"), ARTICLE.format('<pre>echo "${name}" {{ title }}</pre>'), ARTICLE.format("<noscript>Please enable JavaScript.</noscript>"),
    ARTICLE.format("<p>Some readers switch JavaScript off; Mills still serves them plain text.</p>"), "", "<p>", "<<<>>><p", ARTICLE.format("") + "<div><p>This site requires cookies.</p></div>",
])
def test_pages_that_are_not(spark, body):  # noqa: ANN001
    assert found(spark, [(1, "http://a.example/", f"<html><title>{{{{title}}}}</title><body>{body}</body></html>")]) == []


def test_message_in_an_unknown_language(spark):  # noqa: ANN001
    """It recurs on many sites and stands where they have no text of their own;
    a notice that recurs beside articles does not, wrapped or not."""
    notice, message = "<div><p>Vi bruger cookies til statistik.</p></div>", "<div><p>Siden {} blev ikke fundet på serveren.</p></div>"
    article = "<div><h1>Møller {0}</h1><p>Møllerne i dalen nummer {1} blev repareret om foråret.</p></div>"
    words = ["alpha", "bravo", "carol", "delta", "eagle", "fargo"]
    pages = [(i, f"http://{w}.example/x", f"<body>{notice}{message.format(17 * i)}</body>") for i, w in enumerate(words)]
    pages += [(100 + i, f"http://{w}.example/y{c}", f"<body><div>{notice}{article.format(w, w + c)}</div></body>") for i, (w, c) in enumerate((w, c) for w in words for c in "xyzuvwpqrst")]
    assert found(spark, pages) == list(range(6))
    assert {r.by for r in R.page_findings(frame(spark, pages)).collect()} == {"recurring"}


def test_deep_nesting(spark):  # noqa: ANN001
    page = "<div>" * 3000 + "<p>The page you are looking for could not be found." + "<b>" * 3000
    assert found(spark, [(1, "http://a.example/", page)]) == [1]


def test_no_bounds_on_length(spark):  # noqa: ANN001
    """Long messages and long placeholders are cases."""
    long = "The page you are looking for could not be found. " * 40
    pages = [(1, "http://a.example/", f"<p>{long}</p>"), (2, "http://b.example/", ARTICLE.format("<p>It is {{ " + "very " * 50 + "long }} so.</p>")), (3, "http://c.example/", ARTICLE.format("<p>Text. TODO: replace it</p>"))]
    assert found(spark, pages) == [1, 2, 3]


def test_recurring_titles(spark):  # noqa: ANN001
    """A title that tells of an error in words that are on no list counts where
    it recurs across hosts."""
    rows = [(i, f"Connection error {i} | Site{i}", f"h{i}.example") for i in range(4)] + [(9, "Permission slips", "h.example")]
    assert sorted(r.doc_id for r in R.residue_titles(spark.createDataFrame(rows, "doc_id long, title string, host string")).collect()) == [0, 1, 2, 3]
    assert R.residue_titles(spark.createDataFrame(rows[:1], "doc_id long, title string, host string")).collect() == []


def test_tables(spark):  # noqa: ANN001
    bad = "<body><p>Too many requests from your network. Try again later.</p></body>"
    weak = "<body><p>A captcha wall stands before this content of {}</p></body>"
    pages = [(1, "http://a.example/x", bad, 200), (1, "http://a.example/x", bad, 200), (2, None, None, 404), (3, "nonsense", "", 500), (None, "x", bad, 200), (4, "u", ARTICLE.format("") * 3000, 404)]
    pages += [(10 + i, f"http://{site}.example/", weak.format(site), None) for i, site in enumerate(["aaaa", "bbbb", "cccc"])] + [(20, "http://dddd.example/", "<p>A human error in the ledger of dddd", None)]
    frame = spark.createDataFrame([(*p, "k", "f") for p in pages], "page_no long, url string, html string, status_code int, key string, found string")
    assert sorted(r.page_no for r in R.residue_pages(frame).collect()) == [1, 10, 11, 12]  # a text that resembles a message counts where it recurs
    titles = spark.createDataFrame([(1, "403 Forbidden", None, "x"), (1, "403 Forbidden", None, "x"), (2, None, "h", "x"), (3, " ", "h", "x"), (None, "403 Forbidden", "h", "x"), (4, "Mills", "h", "x")], "doc_id long, title string, host string, key string")
    assert [r.doc_id for r in R.residue_titles(titles).collect()] == [1]
    assert R.residue_pages(frame.limit(0)).collect() == [] == R.residue_titles(titles.limit(0)).collect()

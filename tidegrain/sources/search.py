"""Search results as candidate tables."""

from __future__ import annotations

from urllib.parse import parse_qs, urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.functions.urls import host
from tidegrain.operators.pages import per_page
from tidegrain.sources.html import joined_text, parse


def _result(base: str, target: str) -> str | None:
    """The address a result leads to, if it is http(s) on another host."""
    try:
        address = urljoin(base, target.strip())
        inner = parse_qs(urlsplit(address).query).get("uddg")
        parts = urlsplit(inner[0] if inner else address)
    except ValueError:
        return None
    away = parts.netloc.lower() != urlsplit(base).netloc.lower() or not urlsplit(base).netloc
    return parts.geturl() if parts.scheme in ("http", "https") and away else None


def result_anchors(page: str, base: str) -> list[tuple[str, str]]:
    """Distinct (address, label) of the results on a page of search results."""
    out: dict[str, str] = {}
    for element in parse(page).elements():
        target = element.attributes.get("href", "")
        marked = "result__a" in element.attributes.get("class", "").split() or "/l/?" in target.lower() or "uddg=" in target.lower()
        if element.tag == "a" and target.strip() and marked:
            address, label = _result(base, target), joined_text(element, frozenset())
            if address and label:
                out.setdefault(address, label)
    return list(out.items())


def result_pages(pages: DataFrame) -> DataFrame:
    """(page_no, url, target, label) of the results on each page."""
    return per_page(pages, lambda p, u, h, _: [(p, u, *x) for x in result_anchors(h, u)], "page_no long, url string, target string, label string").distinct()


def api_results(answers: DataFrame) -> DataFrame:
    """(query_id, rank, url, title) of the answers of a search service, JSON in
    ``body``; what doesn't parse gives no rows."""
    schema = "struct<web: struct<results: array<struct<url: string, title: string>>>>"
    found = answers.select("query_id", F.posexplode(F.from_json("body", schema)["web"]["results"]).alias("rank", "r"))
    return found.where("trim(r.url) != ''").select("query_id", (F.col("rank") + 1).alias("rank"), "r.url", "r.title")


def provider_list(text: Column) -> Column:
    """Providers named in a text, by commas or lines: each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def provider_name(address: Column) -> Column:
    return F.when(F.trim(address) == "brave://search", "brave").otherwise(F.coalesce(host(address), F.lit("web_search_bootstrap")))


def search_address(base: Column, goal: Column) -> Column:
    """The address of a search for a goal."""
    joint = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(base, joint, F.lit("q="), F.url_encode(goal))


def fetch_profile(name: Column) -> Column:
    """The profile of a fetch: browser_like unless another known one is named."""
    return F.when(F.lower(F.trim(name)).isin("standard", "browser_like", "hardened"), F.lower(F.trim(name))).otherwise("browser_like")


def retry_profile(name: Column) -> Column:
    """The profile of a second fetch: hardened by default, none if unknown."""
    plain = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(plain == "", "hardened").when(plain.isin("standard", "browser_like", "hardened"), plain).otherwise("none")

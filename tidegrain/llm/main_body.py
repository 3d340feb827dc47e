"""The main body of pages, by a style tree of each site.

The pages of a host are merged into one tree.  A content node that recurs on
many of its pages is little important, one that changes from page to page is
important.  A presentation node (a container of text, at whatever depth its
wrappers put it) is the more important the more its ways of layout vary, the
more important the heading of its section is and the more important its content
is.  Both are measured by entropy.  The branches that are less important than
the most important one are removed from each page, and little important branches
and nodes within that one.

How often a node recurs on a small site is leant on how often it recurs within
the other sites that show it, so single pages and small sites can be judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.llm.residue import _host, mask, site_words
from tidegrain.runtime import join_small, stage
from tidegrain.sources.html import parse, text_nodes

#: Importance below which a content node is removed from the main branch.
CONTENT_IMPORTANCE = 0.6
#: Pages of the merged tree at which importance is measured, so that large and
#: small sites are judged alike.
TREE_PAGES = 100
#: Pages with which a site's own rate leans on that of other sites.
LEAN = 20.0
#: What a branch is worth whose layout, and whose section heading, is always
#: the same, against one where they always differ.
LAYOUT_FLOOR, SECTION_FLOOR = 0.2, 0.02
#: How many times as important a branch is taken to be for a page heading in it.
HEADING_PRIOR = 5.0
#: Tags (fixed values) whose elements are branches of the tree.
CONTAINERS = frozenset("div section main article nav aside header footer form center body html".split())
_CRUMB = re.compile(r"\s+[›»>/→·|]\s+")
_LETTERS = re.compile(r"[^\W\d_]")


def content_key(text: str, site: frozenset[str]) -> str:
    """What recurs of a text: masked and in lower case; of a trail of
    breadcrumbs only its form; empty if it has no letters."""
    masked = mask(text, site)
    parts = _CRUMB.split(masked)
    if len(parts) > 2 and max(len(p) for p in parts) < 60:
        return f"trail of {min(len(parts), 3)}"
    return masked.lower() if _LETTERS.search(masked) else ""


def home(path: str | None) -> str:
    """The innermost container around a node that is only in containers."""
    parts = (path or "").split("/")
    n = 1
    while n < len(parts) - 1 and parts[n].partition("[")[0] in CONTAINERS:
        n += 1
    return "/".join(parts[:n])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page_no, url, pos, path, tag, level, text in zip(batch["page_no"], batch["url"], batch["pos"], batch["path"], batch["tag"], batch["heading_level"], batch["text"], strict=True):
            host = _host(url)
            text = text or ""
            out.append((page_no, host, xxhash.xxh64_intdigest((url or "").strip()) - 2**63 if url else page_no, pos, home(path), tag or "", level == 1 or tag == "h1", content_key(text, site_words(host)), len(text.split())))
        yield pd.DataFrame(out, columns=["page_no", "host", "address", "pos", "home", "tag", "heading", "key", "words"])


_FIELDS = "page_no long, host string, address long, pos int, home string, tag string, heading boolean, key string, words int"
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


def _branches(threshold: float):  # noqa: ANN202
    """The branches of each page: (page_no, host, branch, lead, form, heading,
    section, weight, all, low).

    A branch is an outermost container that text stands in directly.  ``lead``
    is its first tag, ``form`` its layout, ``section`` the importance of its
    first heading, ``weight`` its words times their importance; ``all`` are its
    nodes, ``low`` those that are not main body even if the branch is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_no, nodes in zip(batch["page_no"], batch["nodes"], strict=True):
                once: dict[int, dict] = {}
                for n in nodes:
                    n = n if isinstance(n, dict) else n.asDict()
                    if n["pos"] not in once or tuple(n.values()) < tuple(once[n["pos"]].values()):
                        once[n["pos"]] = n
                homes = {n["home"] for n in once.values()}
                found: dict[str, list[dict]] = {}
                for _, n in sorted(once.items()):
                    parts = n["home"].split("/")
                    n["branch"] = next(p for p in ("/".join(parts[: i + 1]) for i in range(len(parts))) if p in homes)
                    found.setdefault(n["branch"], []).append(n)
                for branch, own in found.items():
                    tags = [n["tag"] for n in own]
                    form = " ".join(t for t, before in zip(tags, [None, *tags[:-1]], strict=True) if t != before)
                    section = next((n["importance"] for n in own if n["tag"] in _HEADINGS), 1.0)
                    inner: dict[str, list[dict]] = {}
                    for n in own:
                        if n["home"] != branch:
                            inner.setdefault(n["home"], []).append(n)
                    cut = {h for h, ns in inner.items() if not any(n["heading"] for n in ns) and next((n["importance"] for n in ns if n["tag"] in _HEADINGS), 1.0) < threshold}
                    low = [n["pos"] for n in own if n["home"] in cut or (n["importance"] < threshold and not n["heading"] and n["tag"] not in ("pre", "code", "td", "th"))]
                    out.append((page_no, own[0]["host"], branch, tags[0], form, any(n["heading"] for n in own), section, sum(n["importance"] * n["words"] for n in own), [n["pos"] for n in own], low))
            yield pd.DataFrame(out, columns=["page_no", "host", "branch", "lead", "form", "heading", "section", "weight", "all", "low"])

    return run


_BRANCH = "page_no long, host string, branch string, lead string, form string, heading boolean, section double, weight double, all array<int>, low array<int>"


def _importance(rate: Column) -> Column:
    """Importance of a node that another page of the tree shows with ``rate``:
    1 less its entropy over the pages, as a share of the greatest entropy."""
    return 1 - F.log(1 + rate * (TREE_PAGES - 1)) / float(np.log(TREE_PAGES))


def _recurring(nodes: DataFrame) -> DataFrame:
    """(host, h, importance) of the little important content of each site.

    Pages are counted by address, so that one fetched twice counts once.  What
    recurs within the sites that show it, small and large ones alike, recurs on
    this one too, even if it was not seen here often.
    """
    shown = nodes.where("key != ''").groupBy("host", "h", "address").agg(F.lit(1).alias("_")).groupBy("host", "h").agg(F.count("*").alias("pages"))
    sites = nodes.groupBy("host", "address").agg(F.lit(1).alias("_")).groupBy("host").agg((F.count("*") - 1).alias("more"))
    shown = stage(join_small(shown, stage(sites), ["host"]).select("host", "h", (F.col("pages") - 1).alias("again"), "more"))
    share = F.least("more", F.lit(LEAN))
    others = shown.where("more > 0").groupBy("h").agg((F.sum(share * F.col("again") / F.col("more")) / F.sum(share)).alias("rate"), F.count("*").alias("sites"))
    others = others.select("h", (F.col("rate") * F.col("sites") / (F.col("sites") + 2)).alias("elsewhere"))
    others = stage(others.where(_importance(F.col("elsewhere")) < 0.9))
    joined = join_small(shown, others, ["h"], "left").withColumn("elsewhere", F.coalesce("elsewhere", F.lit(0.0)))
    rate = (F.col("again") + F.col("elsewhere") * LEAN) / (F.col("more") + LEAN)
    return joined.select("host", "h", _importance(F.greatest(rate, "elsewhere")).alias("importance")).where("importance < 0.9")


def _layouts(branches: DataFrame) -> DataFrame:
    """(host, lead, layout) importance of the layouts of branches that begin
    alike: entropy of their forms over the pages, as a share of the greatest."""
    forms = branches.groupBy("host", "lead", "form").agg(F.count("*").alias("n"))
    whole = forms.groupBy("host", "lead").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.log("all") - F.col("s") / F.col("all")
    return whole.select("host", "lead", F.when(F.col("all") > 1, entropy / F.log("all")).otherwise(1.0).alias("layout"))


def branch_choice(nodes: DataFrame, threshold: float = CONTENT_IMPORTANCE) -> DataFrame:
    """The branches of each page with their importance: (page_no, branch,
    heading, importance, main, all, low), see ``_branches``; the importance is
    that before the prior for a page heading."""
    read = nodes.where("page_no IS NOT NULL AND pos IS NOT NULL").select("page_no", "url", "pos", "path", "tag", "heading_level", "text")
    read = stage(read.mapInPandas(_read, _FIELDS).withColumn("h", F.xxhash64("key")))
    low = stage(_recurring(read))
    rated = join_small(read, low, ["host", "h"], "left").withColumn("importance", F.coalesce("importance", F.lit(1.0)))
    node = F.struct("pos", "home", "host", "tag", "heading", "importance", "words")
    pages = rated.groupBy("page_no").agg(F.collect_list(node).alias("nodes"))  # of one page
    branches = stage(pages.mapInPandas(_branches(threshold), _BRANCH).withColumn("form", F.xxhash64("form")))
    layouts = stage(_layouts(branches))
    varied = LAYOUT_FLOOR + (1 - LAYOUT_FLOOR) * F.coalesce("layout", F.lit(1.0))
    weighed = join_small(branches, layouts, ["host", "lead"], "left").withColumn("importance", F.col("weight") * (SECTION_FLOOR + F.col("section")) * varied)
    prior = F.col("importance") * F.when(F.col("heading"), HEADING_PRIOR).otherwise(1.0)
    order = Window.partitionBy("page_no").orderBy(prior.desc(), "branch")
    return weighed.withColumn("main", F.row_number().over(order) == 1).select("page_no", "branch", "heading", "importance", "main", "all", "low")


def not_main_body(nodes: DataFrame, threshold: float = CONTENT_IMPORTANCE) -> DataFrame:
    """Distinct (page_no, pos) of nodes that are not main body.

    ``nodes``: page_no, url, pos, path, tag, heading_level, text; other columns
    are ignored, a null kind among them.  Null keys are no nodes, null paths
    stand in a container of their own, null texts are empty, a null url is an
    unknown site; a node delivered twice counts once; an empty table gives no
    rows.  The page's heading is a prior: the branch it stands in counts as
    HEADING_PRIOR times as important.
    """
    return branch_choice(nodes, threshold).select("page_no", F.explode(F.when(F.col("main"), F.col("low")).otherwise(F.col("all"))).alias("pos")).distinct()


def page_nodes(pages: DataFrame) -> DataFrame:
    """The text-bearing nodes of pages (page_no, url, html), nothing pruned; a
    page delivered twice has its nodes twice, one without html has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(page_no, url, pos, path, tag, level, text) for page_no, url, page in zip(batch["page_no"], batch["url"], batch["html"], strict=True) for pos, (path, tag, _, text, _, level) in enumerate(text_nodes(parse(page), None))]
            yield pd.DataFrame(out, columns=["page_no", "url", "pos", "path", "tag", "heading_level", "text"])

    read = pages.where("page_no IS NOT NULL AND html IS NOT NULL").select("page_no", "url", "html")
    return read.mapInPandas(run, "page_no long, url string, pos int, path string, tag string, heading_level int, text string")


def main_texts(nodes: DataFrame, threshold: float = CONTENT_IMPORTANCE) -> DataFrame:
    """(page_no, text) of each page with a main body, nodes divided by ``\\n``."""
    once = nodes.where("page_no IS NOT NULL AND pos IS NOT NULL").groupBy("page_no", "pos").agg(F.max("text").alias("text"))
    kept = once.join(not_main_body(nodes, threshold), ["page_no", "pos"], "left_anti").where("text IS NOT NULL")
    return kept.groupBy("page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))

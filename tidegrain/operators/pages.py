"""Pages to rows: nodes, links, segments; one pass over each page, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.sources import html

#: Bytes of a segment at most.
SEGMENT_BYTES = 1200
NODE_FIELDS = "page_no long, pos int, path string, tag string, kind string, text string, depth int, heading_level int"
SEGMENT_FIELDS = "page_no long, url string, title string, idx int, kind string, heading_path array<string>, text string, node_paths array<string>, kind_match boolean, heading_backed boolean, embedded boolean, mean_depth double, embedded_count long, heading_ratio double, short_text_ratio double"


#: Extensions of source code and data among pages that are no HTML (fixed values).
CODE_EXTENSIONS = frozenset(".rs .go .py .js .ts .tsx .jsx .java .c .cc .cpp .h .hpp .rb .php .swift .kt .sh .bash .zsh .toml .yaml .yml .json .xml".split())
#: Lines of a block of code.
CODE_LINES = 32


def is_html(content_type: str | None) -> bool:
    """A missing type counts as HTML."""
    kind = (content_type or "").strip().lower()
    return not kind or "text/html" in kind or "application/xhtml+xml" in kind


def text_nodes(page: str, url: str) -> tuple[str, list[tuple]]:
    """Title and nodes of a page that is no HTML: paragraphs divided at blank
    lines, or for source code blocks of lines.  The title is the file name, or
    the host."""
    try:
        parts = urlsplit((url or "").strip())
        path, host = parts.path, parts.hostname or ""
    except ValueError:
        path, host = "", ""
    name = path.rstrip("/").rpartition("/")[2]
    title = name or host or (url or "").strip()
    if f".{name.rpartition('.')[2].lower()}" in CODE_EXTENSIONS and "." in name:
        lines = [x.rstrip("\r") for x in page.strip().split("\n")]
        blocks = ["\n".join(lines[i : i + CODE_LINES]).strip() for i in range(0, len(lines), CODE_LINES)]
        tag, kind = "pre", "code"
    else:
        blocks = [x for x in (" ".join(block.split()) for block in page.strip().split("\n\n")) if x]
        tag, kind = "p", "paragraph"
    return title, [(f"/{tag}[{i + 1}]", tag, kind, block, 1, 0) for i, block in enumerate(blocks) if block]


def reduced_page(page: str, url: str, content_type: str | None, profile: str) -> tuple[str, list[tuple]]:
    """Title and reduced nodes of a page, as its content type says."""
    if not is_html(content_type):
        return text_nodes(page, url)
    root = html.parse(page)
    return html.title(root), html.reduced(root, profile)


def per_page(pages: DataFrame, read: Callable[[int, str, str, str], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``read(page_no, url, html, content_type)`` for each page with
    html; the type is empty where the table has none.  Pages delivered twice
    are read twice, so callers make rows distinct if need be."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, u, h, c in zip(batch["page_no"], batch["url"], batch["html"], batch["content_type"], strict=True) for r in read(p, u or "", h, c)]
            yield pd.DataFrame(rows, columns=names)

    usable = pages.where("page_no IS NOT NULL AND html IS NOT NULL")
    kind = F.coalesce(F.col("content_type").cast("string"), F.lit("")) if "content_type" in pages.columns else F.lit("")
    return usable.select("page_no", "url", "html", kind.alias("content_type")).mapInPandas(run, schema)


def nodes(pages: DataFrame, profile: str | None = "standard") -> DataFrame:
    """The reduced nodes of each page; with profile None nothing is left out."""

    def read(page_no: int, url: str, page: str, content_type: str) -> list[tuple]:
        unpruned = profile is None and is_html(content_type)
        found = html.text_nodes(html.parse(page), None) if unpruned else reduced_page(page, url, content_type, profile or "standard")[1]
        return [(page_no, i, *n) for i, n in enumerate(found)]

    return per_page(pages, read, NODE_FIELDS)


def page_links(pages: DataFrame, same_host: bool = False) -> DataFrame:
    """(page_no, url, target, label) of the distinct links of each page."""
    return per_page(pages, lambda p, u, h, _: [(p, u, *x) for x in html.links(html.parse(h), u, same_host)], "page_no long, url string, target string, label string").distinct()


def page_identities(pages: DataFrame) -> DataFrame:
    """(page_no, kind, target) of canonical, alternate and og:url references."""
    return per_page(pages, lambda p, u, h, _: [(p, *x) for x in html.identity_references(html.parse(h), u)], "page_no long, kind string, target string").distinct()


def fold(found: list[tuple], title: str) -> list[dict]:
    """Segments of nodes (path, tag, kind, text, depth, heading_level) in order.

    Headings only set the heading path.  Neighbours of the same kind and path
    become one segment while it stays within SEGMENT_BYTES.
    """
    stack: list[str] = []
    out: list[dict] = []
    for path, _, kind, text, depth, level in found:
        if kind == "heading":
            if level > 0:
                stack = [*stack[: level - 1], text]
            continue
        under = stack or ([title] if title.strip() else [])
        size = len(text.encode())
        last = out[-1] if out else None
        if last and last["kind"] == kind and last["heading_path"] == under and last["bytes"] + 2 + size <= SEGMENT_BYTES:
            last["text"] += "\n\n" + text
            last["bytes"] += 2 + size
            last["node_paths"].append(path)
            last["depths"].append(depth)
        else:
            out.append({"kind": kind, "heading_path": list(under), "text": text, "bytes": size, "node_paths": [path], "depths": [depth]})
    return out


def segments(pages: DataFrame, profile: str = "standard") -> DataFrame:
    """The segments of each page with what its nodes tell of them.

    A page without nodes but with a title gets it as heading and paragraph.
    """

    def read(page_no: int, url: str, page: str, content_type: str) -> list[tuple]:
        title, found = reduced_page(page, url, content_type, profile)
        short = [len(n[3].strip().encode()) < 48 for n in found if n[3].strip()]
        signs = (sum(n[0].startswith("/embedded/") for n in found), sum(n[2] == "heading" for n in found) / max(len(found), 1), sum(short) / max(len(short), 1))
        found = found or ([("/title[1]", "h1", "heading", title, 1, 1), ("/title[1]/p[1]", "p", "paragraph", title, 1, 0)] if title else [])
        rows = []
        for i, s in enumerate(fold(found, title)):
            depths = [d for d in s["depths"] if d > 0]
            embedded = any(p.startswith("/embedded/") for p in s["node_paths"])
            rows.append((page_no, url, title, i, s["kind"], s["heading_path"], s["text"], s["node_paths"], True, False, embedded, sum(depths) / len(depths) if depths else 0.0, *signs))
        return rows

    return per_page(pages, read, SEGMENT_FIELDS)


def signals(of_nodes: DataFrame) -> DataFrame:
    """Per page: nodes, share of short texts (under 48 bytes) and of headings,
    and embedded nodes."""
    filled = of_nodes.where("trim(text) != ''")
    short = (F.octet_length(F.trim("text")) < 48).cast("double")
    return filled.groupBy("page_no").agg(
        F.count("*").alias("node_count"), F.avg(short).alias("short_text_ratio"), F.avg((F.col("kind") == "heading").cast("double")).alias("heading_ratio"), F.count_if(F.col("path").startswith("/embedded/")).alias("embedded_count"),
    )


#: Marks of what a page is built with (fixed values).
APP_MARKS = ["window._a2s", "__next_data__", "__nuxt__", "__apollo_state__", "<app-root", "data-reactroot"]
THEME_MARKS = ["wp-content", "wp-json", "wp-includes", "et_pb", "elementor", "swiper", "gsap"]


def substrate(page: Column, content_type: Column | None = None) -> Column:
    """What the source of a page shows it to be built with; plain_text if its
    content type is not that of HTML."""
    lower = F.lower(page)
    any_of = lambda marks: F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: lower.contains(m))
    kind = F.lit("") if content_type is None else F.lower(F.trim(F.coalesce(content_type, F.lit(""))))
    plain = (kind != "") & ~kind.contains("text/html") & ~kind.contains("application/xhtml+xml")
    return F.when(plain, "plain_text").when(any_of(APP_MARKS), "embedded_app_payload").when(any_of(THEME_MARKS), "theme_heavy_wordpress").otherwise("generic_content")


def title_by_pattern(page: Column) -> Column:
    """The title by a pattern, without a parser; entities stay."""
    return F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " "))


def text_blocks(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, block) of plain texts, divided at blank lines."""
    pieces = F.posexplode(F.split("text", "\n\n")).alias("pos", "block")
    one = F.trim(F.regexp_replace("block", r"(?U)\s+", " "))
    return texts.where("text IS NOT NULL").select("doc_id", pieces).select("doc_id", "pos", one.alias("block")).where("block != ''")


def line_blocks(texts: DataFrame, size: int = 32) -> DataFrame:
    """(doc_id, pos, block) of code, ``size`` lines a block; no shuffle."""
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(lines, i * size + 1, F.lit(size)), "\n"))
    return texts.where("text IS NOT NULL").select("doc_id", F.posexplode(cut).alias("pos", "block"))

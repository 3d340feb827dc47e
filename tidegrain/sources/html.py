"""HTML pages as element trees, and what is read from them.

The parser takes one pass over the tags.  Void elements, raw text, missing end
tags and end tags without a start are treated as browsers do in the main.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
KINDS = {"p": "paragraph", "blockquote": "paragraph", "li": "list_item", "pre": "code", "code": "code", "td": "table_cell", "th": "table_cell"} | {f"h{i}": "heading" for i in range(1, 7)}
NOISE_TAGS = frozenset("aside button footer form header iframe input label nav noscript script style svg".split())
NOISE_HINTS = ["cookie", "consent", "banner", "promo", "advert", "ads", "nav", "footer", "header", "sidebar", "comment", "modal", "popup"]
MORE_HINTS = {"aggressive": ["related", "share", "newsletter", "social", "hero", "toolbar"], "forum": ["trending", "reaction", "avatar", "signature", "profile-card"]}
PAYLOAD_MARKS = ["window._a2s", "window.__next_data__", "application/ld+json", '"description":"', '"subtitle":"', '"title":"', '"business_name":"']
PAYLOAD_KEYS = ["description", "subtitle", "title", "name", "business_name"]
#: Elements that end an open paragraph.
_BLOCK = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Open elements that a start tag closes, and those that it can't reach across.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)

    def elements(self) -> Iterator[Element]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            top = stack.pop()
            yield top
            stack.extend(c for c in reversed(top.children) if isinstance(c, Element))


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(source))} if source.strip() else {}


def parse(page: str) -> Element:
    """The tree of a page, always with one body below html."""
    root, head, body = Element("html"), Element("head"), Element("body")
    root.children = [head, body]
    stack, at = [root, body], 0

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].children.append(html.unescape(page[at:upto]))

    while m := _TAG.search(page, at):
        text(m.start())
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag in ("html", "head", "body"):
            if not closing and tag == "body":
                body.attributes |= _attributes(m.group(3))
            continue
        if closing:
            found = next((i for i in range(len(stack) - 1, 1, -1) if stack[i].tag == tag), None)
            if found is not None:
                del stack[found:]
            continue
        if tag in _BLOCK:
            paragraph = next((i for i in range(len(stack) - 1, 1, -1) if stack[i].tag == "p"), None)
            if paragraph is not None:
                del stack[paragraph:]
        if tag in _SIBLINGS:
            closed, walls = _SIBLINGS[tag]
            for i in range(len(stack) - 1, 1, -1):
                if stack[i].tag in closed:
                    del stack[i:]
                    break
                if stack[i].tag in walls:
                    break
        element = Element(tag, _attributes(m.group(3)))
        if tag in ("title", "meta", "link", "base") and not body.children:
            head.children.append(element)
        else:
            stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            element.children.append(inner if tag in ("script", "style") else html.unescape(inner))
            at = end.end() if end else len(page)
        elif tag not in VOID and not m.group(3).rstrip().endswith("/"):
            stack.append(element)
    text(len(page))
    return root


def joined_text(element: Element, skip: frozenset[str] = NOISE_TAGS) -> str:
    """The text below an element: each text on one line, joined by blanks."""
    out: list[str] = []
    stack: list[Element | str] = [element]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if words := top.split():
                out.append(" ".join(words))
        elif top is element or top.tag not in skip:
            stack.extend(reversed(top.children))
    return " ".join(out)


def is_noise(element: Element, profile: str) -> bool:
    """Whether an element is left out with all below it."""
    if element.tag in NOISE_TAGS or "hidden" in element.attributes or element.attributes.get("aria-hidden", "").lower() == "true":
        return True
    hints = NOISE_HINTS + MORE_HINTS.get(profile.strip().lower(), [])
    return any(h in element.attributes.get(a, "").lower() for a in ("class", "id", "role") for h in hints)


def text_nodes(root: Element, profile: str | None = "standard") -> list[tuple[str, str, str, str, int, int]]:
    """(path, tag, kind, text, depth, heading_level) of the nodes that bear text.

    A path counts siblings of the same tag that are not left out.  With profile
    None nothing is left out; noise elements then count and bear text too.
    """
    out: list[tuple[str, str, str, str, int, int]] = []
    skip = NOISE_TAGS if profile is not None else frozenset(["script", "style"])

    body = next(e for e in root.children if isinstance(e, Element) and e.tag == "body")
    open_ = [(iter(body.children), ("html[1]", "body[1]"), {})]
    while open_:  # a stack, as pages may be nested to any depth
        children, path, counts = open_[-1]
        child = next(children, None)
        if child is None:
            open_.pop()
            continue
        if isinstance(child, str) or (child.tag in ("script", "style") if profile is None else is_noise(child, profile)):
            continue
        counts[child.tag] = counts.get(child.tag, 0) + 1
        own = (*path, f"{child.tag}[{counts[child.tag]}]")
        if kind := KINDS.get(child.tag):
            if text := joined_text(child, skip):
                out.append(("/" + "/".join(own), child.tag, kind, text, len(own), int(child.tag[1]) if kind == "heading" else 0))
        open_.append((iter(child.children), own, {}))
    return out


def title(root: Element) -> str:
    """The text of the first title element."""
    found = next((e for e in root.elements() if e.tag == "title"), None)
    return joined_text(found) if found else ""


def _json_strings(source: str, key: str) -> Iterator[str]:
    for m in re.finditer(rf'"{key}":"((?:[^"\\]|\\.)*)"', source):
        value = re.sub(r"\\u([0-9a-fA-F]{4})", lambda u: chr(int(u.group(1), 16)), m.group(1))
        yield re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e.group(1), e.group(1)), value).strip()


def payload_nodes(root: Element) -> list[tuple[str, str, str, str, int, int]]:
    """Up to eight texts from data that scripts carry."""
    out = []
    scripts = [" ".join("".join(c for c in e.children if isinstance(c, str)).split()) for e in root.elements() if e.tag == "script"]
    for i, source in enumerate(s for s in scripts if s):
        if not any(mark in source.lower() for mark in PAYLOAD_MARKS):
            continue
        values = list(dict.fromkeys(v for key in PAYLOAD_KEYS for v in _json_strings(source, key) if v))[:24]
        for j, value in enumerate(values):
            text = joined_text(parse(html.unescape(value)))
            junk = "{" in text or "function(" in text or text.count("http") > 4
            if len(text.encode()) >= 30 and not junk:
                out.append((f"/embedded/script[{i + 1}]/text[{j + 1}]", "script", "paragraph", text, 3, 0))
                if len(out) == 8:
                    return out
    return out


def reduced(root: Element, profile: str = "standard") -> list[tuple[str, str, str, str, int, int]]:
    """The nodes of a page; of one with fewer than two also its payload."""
    found = text_nodes(root, profile)
    return found + payload_nodes(root) if len(found) < 2 else found


def links(root: Element, base: str, same_host: bool = False) -> list[tuple[str, str]]:
    """Distinct (address, label) of the links of a page, resolved; http(s) only."""
    out: dict[str, str] = {}
    host = urlsplit(base).hostname
    for element in root.elements():
        target = element.attributes.get("href", "").strip()
        if element.tag != "a" or not target:
            continue
        try:
            address = urljoin(base, target)
            parts = urlsplit(address)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and not (same_host and parts.hostname != host):
            out.setdefault(address, joined_text(element, frozenset()))
    return list(out.items())


def identity_references(root: Element, base: str) -> list[tuple[str, str]]:
    """(kind, address) of what a page names as its own address."""
    out = []
    for e in root.elements():
        rel = e.attributes.get("rel", "").lower()
        if e.tag == "link" and rel in ("canonical", "alternate") and e.attributes.get("href"):
            out.append((rel, urljoin(base, e.attributes["href"].strip())))
        if e.tag == "meta" and e.attributes.get("property", "").lower() == "og:url" and e.attributes.get("content"):
            out.append(("og_url", urljoin(base, e.attributes["content"].strip())))
    return list(dict.fromkeys(out))

"""HTML pages as text blocks."""

from __future__ import annotations

from dataclasses import dataclass

from tidegrain.sources.html import Element, parse

#: Tags (fixed values): without text of their own, that begin a block, that hold
#: code, and that never hold the article where a page is marked up with them.
UNSEEN = frozenset("script style template svg iframe object title".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote pre dd dt figcaption caption center noscript hr".split())
PARTS = frozenset("div ul ol dl table tbody thead tr section main article nav aside footer header form dialog menu".split())
CODE = frozenset("pre code samp kbd textarea".split())
CONTAINERS = frozenset("div section main article nav aside header footer form center".split())
WRAPPERS = frozenset("div section main form center".split())
ASIDE = frozenset("nav aside footer header form dialog menu".split())


@dataclass
class Block:
    """Text of one block: its tag, the number of the branch below the body that
    it stands in, whether that is marked as no article, and whether the text
    is code."""

    tag: str
    branch: int
    aside: bool
    code: bool
    text: str


def blocks(page: str) -> list[Block]:
    """The blocks with text in document order.

    A branch is a block or part directly below the root, or a run of text and
    inline elements between two of them.  The root is the body, or, while all
    text stands in parts of one wrapper that has no text of its own, that
    wrapper.  Elements may be nested to any depth.
    """
    found: list[tuple[str, list[tuple[int, str]], bool, bool, str]] = []
    pieces: list[str] = []
    path: list[tuple[int, str]] = []
    number = 0

    def emit(tag: str, aside: bool, code: bool) -> None:
        text = "".join(pieces).replace("\xa0", " ")
        pieces.clear()
        if text.strip():
            own = path if path and path[-1][1] in BLOCKS else [*path, (number, "")]
            found.append((tag, list(own), aside, code, text.strip() if code else " ".join(text.split())))

    body = next(e for e in parse(page).children if isinstance(e, Element) and e.tag == "body")
    open_ = [(iter(body.children), "", False, False, "part")]
    while open_:
        children, tag, aside, code, kind = open_[-1]
        child = next(children, None)
        if child is None:
            open_.pop()
            if kind != "inline":
                emit(tag, aside, code)
            if kind == "part" and path:
                path.pop()
                number += 1
        elif isinstance(child, str):
            pieces.append(child)
        elif child.tag == "br":
            pieces.append("\n")
        elif child.tag in UNSEEN:
            continue
        elif child.tag in BLOCKS or child.tag in PARTS:
            emit(tag, aside, code)
            number += 1
            path.append((number, child.tag))
            open_.append((iter(child.children), child.tag if child.tag in BLOCKS else tag, aside or child.tag in ASIDE, code or child.tag in CODE, "part"))
        elif child.tag in CODE and not code:
            emit(tag, aside, code)
            open_.append((iter(child.children), tag, aside, True, "code"))
        else:
            open_.append((iter(child.children), tag, aside, code, "inline"))

    level = 0
    while found and len({own[level] for _, own, *_ in found}) == 1 and found[0][1][level][1] in WRAPPERS and all(len(own) > level + 1 and own[level + 1][1] in CONTAINERS for _, own, *_ in found):
        level += 1
    return [Block(tag, own[min(level, len(own) - 1)][0], aside, code, text) for tag, own, aside, code, text in found]

"""Passages of held-out items that occur in documents.

Q-gram lemma: where a passage of L characters occurs with at most E edits, at
least L + 1 - Q * (E + 1) of its Q-grams occur too, within E diagonals of each
other.  All Q-grams of a document are looked up in the Q-grams of the items,
the hits are counted in overlapping diagonal bands per item, and regions that
meet the bound are kept and verified by a banded alignment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, edits allowed in a passage, words of a passage.
Q, EDITS, WORDS = 20, 1, 13
#: Characters of items sent to the executors at once; more are taken in blocks.
BLOCK_CHARS = 8_000_000
#: Characters of documents looked up at once in a worker.
_SLICE = 1_500_000
_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


def words(text: str) -> list[str]:
    """Words after NFKC and without format characters, lower-cased."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        odd = {c for c in set(text) if unicodedata.category(c) == "Cf"}
        if odd:
            text = text.translate({ord(c): None for c in odd})
    return _WORD.findall(text.lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each q-gram, built by doubling from single characters."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    power, length = codes.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    base = _BASE
    while True:
        if q & length:
            whole, done = (power, length) if whole is None else (whole[: len(codes) - done - length + 1] * np.uint64(base) + power[done : len(codes) - length + 1], done + length)
        length *= 2
        if length > q:
            break
        power = power[: len(codes) - length + 1] * np.uint64(base) + power[length // 2 : len(codes) - length // 2 + 1]
        base = base * base % 2**64
    return whole ^ (whole >> np.uint64(31))


def banded_edits(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance of two code arrays within ``band`` diagonals of the
    straight line between their ends; more than ``band`` means no alignment."""
    if abs(len(a) - len(b)) > band:
        return band + 1
    width = 2 * band + 1
    big = len(a) + len(b)
    previous = np.where(np.arange(width) >= band, np.arange(width) - band, big)
    for i in range(1, len(a) + 1):
        row = np.full(width, big)
        for d in range(width):
            j = i + d - band
            if 0 <= j <= len(b):
                if j == 0:
                    row[d] = i
                    continue
                best = previous[d] + (a[i - 1] != b[j - 1])
                if d + 1 < width:
                    best = min(best, previous[d + 1] + 1)
                if d:
                    best = min(best, row[d - 1] + 1)
                row[d] = best
        previous = row
    return int(previous[len(b) - len(a) + band])


class Items:
    """The grams of a block of items, sorted by hash, with their places."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: int, n_words: int):
        self.q, self.edits, self.n_words = q, edits, n_words
        self.ids, self.codes, self.words, least = [], [], [], []
        for item, text in items:
            own = words(text)
            if len(own) < n_words:
                continue
            lengths = np.cumsum([0] + [len(w) + 1 for w in own])
            self.ids.append(item)
            self.words.append(own)
            self.codes.append(_codes(" ".join(own)))
            least.append(int((lengths[n_words:] - lengths[:-n_words]).min()) - 1)
        self.least = np.array(least, np.int64)
        #: A passage too short for the lemma's bound still shares one gram at
        #: least if it is free of edits; shorter ones than q are looked up as words.
        self.bound = np.maximum(self.least + 1 - q * (edits + 1), np.minimum(1, self.least + 1 - q).clip(0))
        grams = [gram_hashes(c, q) for c in self.codes]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.distinct, self.start, self.count = np.unique(self.hashes, return_index=True, return_counts=True)
        self.bits = max(16, int(len(self.distinct) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.distinct >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.short = [i for i in range(len(self.ids)) if self.bound[i] < 1]

    def regions(self, codes: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc, item, windows) of regions of chained windows that meet the
        bound; the rows of ``windows`` are (first, last, item first, item last),
        places of the first and last gram."""
        hashes = gram_hashes(codes, self.q)
        if not len(hashes) or not len(self.distinct):
            return
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        found = np.searchsorted(self.distinct, hashes[at])
        found = np.minimum(found, len(self.distinct) - 1)
        same = (self.distinct[found] == hashes[at]) & (doc_of[at] == doc_of[at + self.q - 1]) & (doc_of[at] >= 0)
        at, found = at[same], found[same]
        n = self.count[found]
        where = np.repeat(at, n)
        entry = np.repeat(self.start[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place, doc = self.item[entry], self.place[entry], doc_of[where]
        width = self.edits + 1
        diagonal = where - place
        band = np.concatenate([diagonal // width, diagonal // width - 1])  # each band is two widths and overlaps the next by one
        item, place, doc, where = (np.concatenate([x, x]) for x in (item, place, doc, where))
        order = np.lexsort((where, band, item, doc))
        item, place, doc, where, band = item[order], place[order], doc[order], where[order], band[order]
        need = self.bound[item]
        end = np.arange(len(item)) + need - 1
        ok = (need > 0) & (end < len(item))
        end = np.where(ok, end, 0)
        ok &= (item[end] == item) & (doc[end] == doc) & (band[end] == band) & (where[end] - where <= self.least[item] + self.edits - self.q)
        start = np.flatnonzero(ok)
        if not len(start):
            return
        end = end[start]
        joins = (item[start[1:]] == item[start[:-1]]) & (doc[start[1:]] == doc[start[:-1]]) & (band[start[1:]] == band[start[:-1]]) & (start[1:] <= end[:-1])
        cuts = np.flatnonzero(np.concatenate([[True], ~joins]))
        for i, j in zip(cuts, np.append(cuts[1:], len(start)) - 1, strict=True):
            s, e = start[i : j + 1], end[i : j + 1]
            yield int(doc[s[0]]), int(item[s[0]]), np.stack([where[s], where[e], place[s], place[e]], axis=1)


def _share_words(text: str, item: list[str], n: int) -> bool:
    text = f" {text} "
    return any(f" {' '.join(item[i : i + n])} " in text for i in range(len(item) - n + 1))


def _region_edits(items: Items, item: int, codes: np.ndarray, first: int, last: int, place: int, place_end: int) -> tuple[int, int, int] | None:
    """(start, length, edits) of a region within its budget of edits."""
    a, b = codes[first : last + items.q], items.codes[item][place : place_end + items.q]
    budget = items.edits * -(-len(b) // max(1, int(items.least[item])))
    edits = 0 if len(a) == len(b) and (a == b).all() else banded_edits(a, b, budget)
    return (first, len(a), edits) if edits <= budget else None


def _passages(items: Items, item: int, codes: np.ndarray, windows: np.ndarray) -> list[tuple[int, int, int]]:
    """A region as a whole or, if it has too many edits, chains of its
    windows, from the left, as long as they have not."""
    check = lambda w, v: _region_edits(items, item, codes, int(w[0]), int(v[1]), int(w[2]), int(v[3]))
    whole = check(windows[0], windows[-1])
    if whole:
        return [whole]
    out, i = [], 0
    while i < len(windows):
        held, last, step = check(windows[i], windows[i]), i, 1
        while held and step:  # doubled while the longer chain holds, then halved
            longer = check(windows[i], windows[last + step]) if last + step < len(windows) else None
            held, last, step = (longer, last + step, step * 2) if longer else (held, last, step // 2)
        if held:
            out.append(held)
        i = last + 1
    return out


def _search(sent, exact: bool):  # noqa: ANN001, ANN202
    """Documents to rows (doc_id, item_id, start, length, edits)."""

    def verified(items: Items, ids: list, texts: list[str]) -> list[tuple]:
        codes, doc_of = [], []
        for i, text in enumerate(texts):
            c = _codes(text)
            codes += [c, np.zeros(1, np.uint32)]
            doc_of += [np.full(len(c), i), np.full(1, -1)]
        codes, doc_of = np.concatenate(codes), np.concatenate(doc_of)
        start_of = np.cumsum([0] + [len(t) + 1 for t in texts])
        best: dict[tuple[int, int], list[tuple]] = {}
        for doc, item, windows in items.regions(codes, doc_of):
            kept = best.setdefault((doc, item), [])
            if not exact:  # for exact words no budget of edits counts
                kept.extend((first - int(start_of[doc]), length, edits) for first, length, edits in _passages(items, item, codes, windows))
        for doc, text in enumerate(texts):
            for item in items.short:
                if _share_words(text, items.words[item], items.n_words):
                    best.setdefault((doc, item), []).append((0, len(text), 0))
        out = []
        for (doc, item), regions in best.items():
            if exact:
                if _share_words(texts[doc], items.words[item], items.n_words):
                    out.append((ids[doc], items.ids[item], 0, 0, 0))
            else:
                out.extend((ids[doc], items.ids[item], *r) for r in set(regions))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = sent.value
        for batch in batches:
            out, ids, texts, size = [], [], [], 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(doc)
                texts.append(" ".join(words(text)))
                size += len(texts[-1])
                if size > _SLICE:
                    out += verified(items, ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                out += verified(items, ids, texts)
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "length", "edits"])

    return run


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` characters, by hash of their id."""
    clean = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    total = clean.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // limit))
    for block in range(blocks):
        part = clean.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id")
        yield [(r.item_id, r.text) for r in part.collect()]


def _leaks(documents: DataFrame, items: DataFrame, exact: bool, q: int, edits: int, n_words: int, limit: int) -> DataFrame:
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    send = texts.sparkSession.sparkContext.broadcast
    parts = [texts.mapInPandas(_search(send(Items(block, q, edits, n_words)), exact), "doc_id long, item_id long, start int, length int, edits int") for block in _blocks(items, limit)]
    return reduce(DataFrame.unionAll, parts).distinct()


def leaked_items(documents: DataFrame, items: DataFrame, q: int = Q, edits: int = EDITS, n_words: int = WORDS, limit: int = BLOCK_CHARS) -> DataFrame:
    """Distinct (doc_id, item_id) that share ``n_words`` consecutive words.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are
    ignored.  Null ids and texts, and items of fewer words, have no cases;
    empty tables give no rows.  Items are sent in blocks of bounded size, each
    compared with whole texts of all documents.  Candidates come from the gram
    filter; an exact comparison of words follows, whatever else of the region
    was edited.
    """
    return _leaks(documents, items, True, q, edits, n_words, limit).select("doc_id", "item_id").distinct()


def leaked_passages(documents: DataFrame, items: DataFrame, q: int = Q, edits: int = EDITS, n_words: int = WORDS, limit: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, length, edits) of passages that are alike but
    for at most ``edits`` edits in the length of ``n_words`` words of the item.

    Places count characters of the document's words joined by single blanks.
    Otherwise as ``leaked_items``.
    """
    return _leaks(documents, items, False, q, edits, n_words, limit)

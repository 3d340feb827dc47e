"""Leaks against a scan of all 13-word runs."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd

from tidegrain.llm import leaks as K

DOCUMENTS = "doc_id long, text string, item_id long, start string"
ITEMS = "item_id long, text string, doc_id string, edits int"


def frames(spark, documents, items):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*d, 1, "s") for d in documents], DOCUMENTS), spark.createDataFrame([(*i, "d", 1) for i in items], ITEMS)


def brute(documents, items, n=13):  # noqa: ANN001, ANN201
    runs = lambda t: {tuple(w[i : i + n]) for w in [K.words(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in documents if t and d is not None for i, s in items if s and i is not None and runs(t) & runs(s)}


def test_against_all_runs(spark):  # noqa: ANN001
    rng = random.Random(8)
    vocabulary = ["mill", "a", "of", "river", "ünder", "x1", "the", "quarry", "señal", "on", "in", "it"] + [f"word{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([5, 13, 40, 90])))) for i in range(30)] + [(90, "a " * 40), (91, None), (None, "x " * 20), (92, "")]
    documents = []
    for d in range(120):
        words, source = text(rng.choice([0, 10, 200])), K.words(rng.choice(items[:30])[1])
        n = rng.choice([0, 12, 13, 14, 30])
        start = rng.randrange(max(1, len(source) - n))
        at = rng.randrange(len(words) + 1)
        words[at:at] = source[start : start + n]
        documents.append((d, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    documents += documents[:3] + [(500, None), (501, "so\xadft " * 3 + items[5][1].replace("m", "m​")), (502, "a " * 13), (None, items[5][1])]
    found = {tuple(r) for r in K.leaked_items(*frames(spark, documents, items)).collect()}
    assert found == brute(documents, items) and len(found) > 20
    in_blocks = {tuple(r) for r in K.leaked_items(*frames(spark, documents, items), limit=500).collect()}
    assert in_blocks == found


def test_edited_passages(spark):  # noqa: ANN001
    passage = "the quick mills of the valley were repaired by careful hands during the long and quiet spring of that year"
    documents = [(1, "before " + passage + " after"), (2, passage.replace("careful", "carefal")), (3, "nothing of the kind")]
    found = {(r.doc_id, r.edits > 0) for r in K.leaked_passages(*frames(spark, documents, [(7, passage)])).collect()}
    assert (1, False) in found and {d for d, _ in found} == {1, 2}


def test_parts():
    text = np.frombuffer("abcabcabc".encode("utf-32-le"), np.uint32)
    for q in (1, 2, 3, 5, 7, 9):
        hashes = K.gram_hashes(text, q)
        assert len(hashes) == 10 - q and all((hashes[i] == hashes[i + 3]) for i in range(max(0, 7 - q)))
    assert K.banded_edits(text, text[1:], 2) == 1 and K.banded_edits(text, text[:3], 2) == 3 and K.banded_edits(text, text, 0) == 0


def test_empty(spark):  # noqa: ANN001
    assert K.leaked_items(*frames(spark, [], [])).collect() == []
    assert K.leaked_items(*frames(spark, [(1, "x " * 30)], [])).collect() == []


def test_verbatim_words_before_edited_ones():
    """13 to 20 words as they are, then text on the same diagonal with more
    edits than the whole stretch may have."""
    rng = random.Random(4)
    item = [rng.choice(["of", "in", "to", "we", "be"]) if i % 4 == 0 else rng.choice(["river", "quarry", "meadow", "lantern"]) + rng.choice("abcdef") for i in range(60)]
    documents = []
    for d in range(150):
        n = rng.randrange(13, 21)
        documents.append((d, " ".join(item[:n] + [rng.choice(["xq", "zj"]) if len(w) == 2 and rng.random() < 0.5 else w for w in item[n:]])))
    sent = SimpleNamespace(value=K.Items([(1, " ".join(item))], K.Q, K.EDITS, K.WORDS))
    batch = pd.DataFrame(documents, columns=["doc_id", "text"])
    for exact in (True, False):
        found = pd.concat(K._search(sent, exact)(iter([batch])))
        assert set(found["doc_id"]) == {d for d, _ in documents}

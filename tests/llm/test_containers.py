"""Every text in containers, none over its capacity."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tidegrain.llm import containers as C

DOCUMENTS = "doc_id long, text string, tokens string, profile string"
BUDGETS = "profile string, capacity_tokens int, doc_id int"


def pack(spark, documents, budgets):  # noqa: ANN001, ANN201
    a = spark.createDataFrame([(*d, "t", "p") for d in documents], DOCUMENTS)
    return C.pack(a, spark.createDataFrame([(*b, 1) for b in budgets], BUDGETS)).collect()


def test_hilbert_curve_is_a_walk():
    """Every cell once, each next to the one before."""
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), axis=-1).reshape(-1, axes)
        key = C.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_all_texts_are_packed(spark):  # noqa: ANN001
    rng = random.Random(1)
    words = ["mill", "river", "señal", "größe", "canal", "table", "of", "the"]
    documents = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 60, 150, 900])))) for i in range(400)]
    encode = C.tokenizer(f"{C.TOKENIZERS}/{C.TOKENIZER}").encode_ordinary
    size = {i: len(encode(t)) for i, t in documents}
    found = pack(spark, documents + documents[:9], [("small", 128), ("large", 1024), ("large", 1024), ("none", 0), (None, 5), ("null", None)])
    for profile, capacity in (("small", 128), ("large", 1024)):
        rows = [r for r in found if r.profile == profile]
        load, pieces = defaultdict(int), defaultdict(list)
        for r in rows:
            load[r.container_id] += r.tokens
            pieces[r.doc_id].append((r.piece_no, r.tokens))
        assert max(load.values()) <= capacity
        assert {d: sum(t for _, t in p) for d, p in pieces.items()} == size
        for d, p in pieces.items():
            assert [n for n, _ in sorted(p)] == list(range(-(-size[d] // capacity)))  # divided only if it has to be
        assert sum(size.values()) >= 0.94 * capacity * (len(load) - 1)  # many texts here are of two thirds of a capacity
    assert {r.profile for r in found} == {"small", "large"}


def test_odd_texts(spark):  # noqa: ANN001
    found = pack(spark, [(1, None), (2, ""), (None, "x"), (3, "word " * 200_000), (4, "<|endoftext|>"), (5, " ")], [("p", 512)])
    assert {r.doc_id for r in found} == {3, 4, 5}
    assert pack(spark, [], [("p", 512)]) == [] == pack(spark, [(1, "x")], [])


@pytest.mark.parametrize("capacity", [10, 11])
def test_exact_fit(capacity):  # noqa: ANN001
    packer = C.Packer(capacity, window=4)
    out = [c for i in range(40) for c in packer.add(i, 0, 5)] + list(packer.flush(True))
    assert sorted(d for c in out for d, _, _ in c) == list(range(40)) and len(out) == 20

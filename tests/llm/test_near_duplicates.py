"""Similar word sets against all pairs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from tidegrain.llm import near_duplicates as N
from tidegrain.llm import queries as Q

FIELDS = "entity string, id long, text string, class_id string, size string, words string"


def frame(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FIELDS)


def brute(rows, threshold=0.8, least=20):  # noqa: ANN001, ANN201
    sets = {(e, i): set(re.findall(r"[^\W_]+", t.lower())) for e, i, t in rows if t is not None and i is not None}
    kept = sorted((k, v) for k, v in sets.items() if len(v) >= least)
    return {(a[0], a[1], b[1]) for (a, x), (b, y) in combinations(kept, 2) if a[0] == b[0] and len(x & y) >= threshold * len(x | y) - 1e-9}


def texts(rng, n):  # noqa: ANN001, ANN201
    """Variants of a few texts from a small vocabulary, some of them long."""
    vocabulary = [f"w{i}" for i in range(150)] + [f"rare{i}" for i in range(2000)]
    base = [[rng.choice(vocabulary[:150]) for _ in range(rng.choice([25, 40, 60]))] + [rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 200]))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 3, 6, 12])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rng.shuffle(words)
        out.append(("chunk" if i % 3 else "summary", i, " ".join(words)))
    return out


@pytest.mark.parametrize("options", [{}, {"few": 2}, {"boundary": 0}, {"boundary": 45}, {"broadcast_words": 0}])
def test_against_all_pairs(spark, options):  # noqa: ANN001
    """With heavy parts, lists only, both ways at once, and joined word counts."""
    rows = texts(random.Random(11), 110)
    found = {tuple(r) for r in N.similar_records(frame(spark, rows), **options).collect()}
    assert found == brute(rows)
    assert len(found) > 30


def test_odd_rows(spark):  # noqa: ANN001
    long = " ".join(f"v{i}" for i in range(5000))
    same = " ".join(f"s{i}" for i in range(20))
    rows = [("chunk", 1, None), ("chunk", 2, ""), ("chunk", 3, "too few words"), ("chunk", 4, long), ("chunk", 5, long + " more"), ("chunk", 6, same), ("chunk", 6, same), ("chunk", 7, same.upper()), ("summary", 8, same), ("chunk", None, same)]
    assert {tuple(r) for r in N.similar_records(frame(spark, rows)).collect()} == {("chunk", 4, 5), ("chunk", 6, 7)}


def test_many_copies(spark):  # noqa: ANN001
    """Large classes come out as a star if that is asked for, and keep their
    links to other texts."""
    same = [f"s{i}" for i in range(30)]
    rows = [("chunk", i, " ".join(same)) for i in range(64 + 20)] + [("chunk", 1000, " ".join([*same[1:], "other"]))]
    found = {tuple(r)[1:] for r in N.similar_records(frame(spark, rows), expand=64).collect()}
    members = range(64 + 20)
    assert found == {(0, i) for i in members if i} | {(i, 1000) for i in members}


def test_empty(spark):  # noqa: ANN001
    assert N.similar_records(frame(spark, [])).collect() == []


def test_query_has_all_pairs_of_large_classes(spark, tmp_path):  # noqa: ANN001
    """Texts in another order of sentences, more than 64 of them,
    beside a similar class as large."""
    same = [f"s{i}" for i in range(30)]
    rng = random.Random(3)
    rows = []
    for i in range(2 * (64 + 3)):
        words = [*same[1:], "other"] if i % 2 else list(same)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "chunk_no long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([], "doc_id long, semantic_summary string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in Q.p3_found(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(brute([("chunk", *r) for r in rows]))
    assert len(found) == len(rows) * (len(rows) - 1) // 2


def test_shared_parts_are_split(spark):  # noqa: ANN001
    """Many sets that share most parts meet in blocks."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(24)]
    rows = [("chunk", i, " ".join([*common, *(f"x{rng.randrange(40)}" for _ in range(rng.choice([2, 4, 6])))])) for i in range(50)]
    assert {tuple(r) for r in N.similar_records(frame(spark, rows), few=1).collect()} == brute(rows)


def test_groups(spark):  # noqa: ANN001
    """Against reaching from record to record."""
    rows = texts(random.Random(7), 120) + [("chunk", 900 + i, " ".join(f"s{j}" for j in range(25))) for i in range(80)]
    near = {}
    for e, a, b in brute(rows):
        near.setdefault((e, a), set()).add(b)
        near.setdefault((e, b), set()).add(a)
    expected = set()
    for e, i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[(e, todo.pop())] - seen
            seen |= new
            todo += new
        expected.add((e, i, min(seen), len(near[(e, i)])))
    assert {tuple(r) for r in N.similar_groups(frame(spark, rows)).collect()} == expected
    assert N.similar_groups(frame(spark, [])).collect() == []


def test_short_texts(spark):  # noqa: ANN001
    """Sets of so few words that most of their parts are empty."""
    rng = random.Random(4)
    rows = [("chunk", i, " ".join(f"x{rng.randrange(12)}" for _ in range(rng.choice([3, 8, 30])))) for i in range(80)]
    assert {tuple(r) for r in N.similar_records(frame(spark, rows), min_words=2, few=1).collect()} == brute(rows, least=2)

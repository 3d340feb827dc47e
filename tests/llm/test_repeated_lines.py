"""Repeated lines against counting all."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from tidegrain.llm import repeated_lines as L

CHUNKS = "chunk_no long, doc_id long, text string, source string, key string, n int"
DOCUMENTS = "doc_id long, host string, text string, source string, width int"


def frames(spark, chunks, documents):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*c, "s", "k", 1) for c in chunks], CHUNKS), spark.createDataFrame([(*d, "t", "s", 1) for d in documents], DOCUMENTS)


def brute(chunks, documents, least=5):  # noqa: ANN001, ANN201
    hosts = defaultdict(set)
    for doc, host in documents:
        if host and host.strip():
            hosts[doc].add(host.strip().lower())
    norm = lambda x: re.sub(r"\s+", " ", re.sub("[0-9]+", "#", x.lower())).strip()
    seen, places = defaultdict(set), defaultdict(set)
    for no, doc, text in chunks:
        for i, line in enumerate((text or "").split("\n"), 1):
            if norm(line):
                for host in hosts[doc]:
                    seen[(host, norm(line))].add(doc)
                    places[(host, norm(line))].add((no, i))
    return {p for k, docs in seen.items() if len(docs) >= least for p in places[k]}


def test_against_counting(spark):  # noqa: ANN001
    rng = random.Random(2)
    lines = ["Share this", "share  THIS ", "\tPage 1 of 20", "page 7 of 3\xa0", "", " ", "© Site"] + [f"line {'x' * i}" for i in range(60)]
    documents = [(d, rng.choice(["A.example", "a.example", "b.example", None, " "])) for d in range(80)]
    chunks = [(c, rng.randrange(85), "\n".join(rng.choice(lines) for _ in range(6))) for c in range(200)]
    chunks += chunks[:5] + [(900, 1, None), (901, None, "Share this"), (902, 1, ""), (903, 2, "word " * 100_000)]
    a, b = frames(spark, chunks, documents)
    found = {tuple(r) for r in L.found_lines(a, b).collect()}
    assert found == brute(chunks, documents) and len(found) > 100


def test_cleaned(spark):  # noqa: ANN001
    chunks = [(d, d, f"Own {'y' * d}\nFoot 1{d}") for d in range(5)] + [(9, 9, None)]
    a, b = frames(spark, chunks, [(d, "h") for d in range(5)])
    assert sorted((r.chunk_no, r.removed_lines, r.text) for r in L.clean_chunks(a, b).collect() if r.chunk_no < 9) == [(d, 1, f"Own {'y' * d}") for d in range(5)]
    assert next(r.text for r in L.clean_chunks(a, b).collect() if r.chunk_no == 9) is None


def test_beyond_the_broadcast_bound(spark, monkeypatch):  # noqa: ANN001
    """All joins salted."""
    import tidegrain.runtime as runtime

    monkeypatch.setattr(L, "join_small", lambda *a, **k: runtime.join_small(*a, **{**k, "limit": 0}))
    chunks = [(d, d, "Foot\nOwn") for d in range(30)]
    a, b = frames(spark, chunks, [(d, "h") for d in range(30)])
    assert L.found_lines(a, b).count() == 60


def test_empty(spark):  # noqa: ANN001
    a, b = frames(spark, [], [])
    assert L.found_lines(a, b).collect() == [] == L.clean_chunks(a, b).collect()


def test_summaries_of_days_merge(spark):  # noqa: ANN001
    """Days of different sizes, folded to the narrowest, miss no line."""
    from pyspark.sql import functions as F

    documents = spark.createDataFrame([(i, "h.example") for i in range(300)], "doc_id long, host string")
    chunks = spark.createDataFrame([(i, i, f"again\nonly {chr(97 + i % 26)} {chr(97 + i // 26)}\n" + ("few" if i in (1, 150, 299) else "")) for i in range(300)], "chunk_no long, doc_id long, text string")
    lines = L.split_lines(chunks, documents)
    days = [L.summaries(lines.where(F.col("doc_id").between(*d))) for d in ((0, 4), (5, 60), (61, 299))]
    summary = L.merged(days[0].unionByName(days[1]).unionByName(days[2]))
    assert summary.agg(F.sum("n"), F.count_distinct("width")).first() == (603, 1)
    rows = lambda s: sorted(tuple(r) for r in L.repeated_lines(lines, 5, s).collect())
    assert rows(summary) == rows(None) and len(rows(None)) == 1

"""Memory search on whole tables against a scan of all rows in Python."""

from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest

from tidegrain.plans import memory_queries as M
from tidegrain.plans import planning_queries as P
from tidegrain.sources.tables import table

ROOT = "/root/testdata/sf0.01"
NOW = datetime(2025, 5, 1)


def recent(at):  # noqa: ANN001, ANN201
    days = None if at is None else (NOW - at).total_seconds() / 86400
    return 0 if days is None else 0.12 if days <= 1 else 0.08 if days <= 7 else 0.04 if days <= 30 else 0


def ratio(x):  # noqa: ANN001, ANN201
    return x if x is not None and x > 0 else 0.0


def usable(v):  # noqa: ANN001, ANN201
    return v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def tables(spark):  # noqa: ANN001, ANN201
    docs, nodes, seen = ([r.asDict() for r in table(spark, ROOT, n).collect()] for n in ("topic_docs", "topic_nodes", "documents"))
    known = {}
    for d in sorted(seen, key=lambda d: (d["observed_at"] or datetime.min, d["doc_id"])):
        known[d["url"]] = d
    asked = {d["vec_id"]: np.array(d["vector"], float) for d in docs if d["vec_id"] % 20 == 0 and usable(d["vector"])}
    return docs, nodes, known, asked


def best(asked, rows, weight, bonus):  # noqa: ANN001, ANN201
    """(query, row) -> score of the five best of all rows with a cosine above 0."""
    out = {}
    for q, v in asked.items():
        scored = []
        for r in rows:
            u = np.array(r["vector"], float)
            sim = float(np.round(u @ v / np.linalg.norm(u) / np.linalg.norm(v), 9))
            if sim > 0:
                scored.append((-round(weight * sim + bonus(r), 9), r["vec_id"], r))
        out |= {(q, r["vec_id"]): (-s, r) for s, _, r in sorted(scored, key=lambda x: x[:2])[:5]}
    return out


def document_bonus(d):  # noqa: ANN001, ANN201
    return recent(d["observed_at"]) + 0.08 * ratio(d["stable_ratio"]) + 0.08 * ratio(d["novelty_ratio"]) + 0.06 * bool(d["changed_recently"]) + 0.08 * bool(json.loads(d["proof_refs_json"] or "[]"))


def node_bonus(n):  # noqa: ANN001, ANN201
    depth = 0.42 / (n["topic_depth"] + 1) if n["topic_depth"] > 0 else 0
    return 0.18 * min(max(n["support_count"] - 1, 0), 4) + 0.12 * min(n["child_count"], 3) + depth + recent(n["observed_at"])


def close(found, wanted):  # noqa: ANN001, ANN201
    assert {k[:-1] for k in found} == {k[:-1] for k in wanted}
    assert sorted(found) == [(*k[:-1], pytest.approx(k[-1], abs=2e-6)) for k in sorted(wanted)]


def test_documents_by_full_score(spark, tables):  # noqa: ANN001
    """Five of the remembered documents, however many other vectors are nearer."""
    docs, _, known, asked = tables
    rows = [d for d in docs if d["url"] in known and usable(d["vector"])]
    wanted = {(q, r["url"], s) for (q, _), (s, r) in best(asked, rows, 3, lambda r: document_bonus(known[r["url"]])).items()}
    found = {tuple(r) for r in M.d16_document_hits(spark, ROOT).collect()}
    close(found, wanted)
    assert len(found) > len(asked)


def test_topics_by_full_score(spark, tables):  # noqa: ANN001
    _, nodes, _, asked = tables
    wanted = {(q, r["topic_key"], r["representative_url"], s) for (q, _), (s, r) in best(asked, [n for n in nodes if usable(n["vector"])], 3.15, node_bonus).items()}
    close({tuple(r) for r in M.d16_topic_hits(spark, ROOT).collect()}, wanted)


def test_search_follows_roots_links_and_hosts(spark, tmp_path):  # noqa: ANN001
    """A page linked to, a root above and a page of the same host come out
    beside the only document with a vector."""
    site = "https://a.example"
    at = "timestamp_ntz'2024-01-01 00:00:00'"
    documents = [(1, f"{site}/x/hit", "/x/hit"), (2, f"{site}/x", "/x"), (3, f"{site}/other", "/other"), (4, "https://b.example/linked", "/linked")]
    frame = spark.createDataFrame([(i, u, u.split("/")[2], p, None, None, False, "[]") for i, u, p in documents], "doc_id long, url string, host string, path string, stable_ratio double, novelty_ratio double, changed_recently boolean, proof_refs_json string")
    frame.selectExpr("*", f"{at} AS observed_at").write.parquet(f"{tmp_path}/documents.parquet")
    vector = [1.0] + [0.0] * 63
    spark.createDataFrame([(20, f"{site}/x/hit", vector)], "vec_id long, url string, vector array<float>").write.parquet(f"{tmp_path}/topic_docs.parquet")
    spark.createDataFrame([], "vec_id long, topic_key string, representative_url string, support_count int, child_count int, topic_depth int, observed_at timestamp_ntz, vector array<float>").write.parquet(f"{tmp_path}/topic_nodes.parquet")
    page = '<html><body><a href="https://b.example/linked">linked</a></body></html>'
    spark.createDataFrame([(1, f"{site}/x/hit", page)], "page_no long, url string, html string").selectExpr("*", f"{at} AS fetched_at").write.parquet(f"{tmp_path}/raw_pages.parquet")
    found = {r.url: r.score for r in M.d15_memory_search(spark, str(tmp_path)).collect()}
    assert found == {f"{site}/x/hit": 3.0, f"{site}/x": 1.72, f"{site}/other": 0.78, "https://b.example/linked": 0.7}


def test_often_seen_address_beyond_the_nearest(spark, tmp_path):  # noqa: ANN001
    """25 pages seen once are a little nearer than one that is seen five times."""
    near = [(i, f"https://a.example/mill{i}", "river quarry lantern meadow") for i in range(25)]
    often = [(100 + i, "https://a.example/often/seen", "river quarry lantern meadow") for i in range(5)]
    spark.createDataFrame(near + often, "doc_id long, url string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "river quarry lantern meadow a example")], "item_id long, goal string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert max(P.d14_local_candidates(spark, str(tmp_path)).collect(), key=lambda r: r.score).url == "https://a.example/often/seen"

"""Languages on held-out samples and mixed texts."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrain.llm import languages as L

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"
FIELDS = "doc_id long, text string, lang string, host string, label string, counts string, prior int"


@pytest.fixture(scope="module")
def samples(spark):  # noqa: ANN001, ANN201
    return spark.read.parquet(SAMPLES)


def frame(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, "l", "c", 1) for r in rows], FIELDS)


def test_held_out(spark, samples):  # noqa: ANN001
    train, held = samples.where("sample_id % 4 != 0"), samples.where("sample_id % 4 = 0").toPandas()
    documents = frame(spark, [(int(r.sample_id), r.text, None, "h.example") for r in held.itertuples()])
    found = {r.doc_id: r.lang for r in L.wrong_labels(documents, train).collect()}
    right = sum(found.get(int(r.sample_id)) == r.lang for r in held.itertuples())
    assert right >= 0.98 * len(held)


def test_labels_and_mixture(spark, samples):  # noqa: ANN001
    text = samples.toPandas().groupby("lang")["text"].apply(list)
    en, de = text["en"][0] + " " + text["en"][1], text["de"][0] + " " + text["de"][1]
    rows = [(i, en, label, "a.example") for i, label in enumerate(["en", "EN", "en-GB", "eng", " en "])]
    rows += [(10, en, None, None), (11, en, "", "A.example"), (12, en, "de", "a.example"), (13, en, "und", "a.example"), (14, en, "nl", "."), (15, de, "deu", "b.example"), (16, f"{en}\n\n{de}", "en", "a.example"), (17, f"{en}\n\n{de}", "de", "a.example")]
    rows += [(20, "Too short to tell.", "fr", "a.example"), (21, None, "fr", "a.example"), (22, "", None, "a.example"), (23, "x = {y: 1}\nfor (;;) { go(); }\n" * 60, "en", "a.example"), (None, en, "de", "a.example"), (12, en, "de", "a.example"), (24, en + " «los plazos fáciles» " + en, "en", "a.example")]
    rows += [(25, (en + " ") * 2000, "pt", "a.example")]
    found = {tuple(r) for r in L.wrong_labels(frame(spark, rows), samples).collect()}
    assert found == {(i, "en") for i in (10, 11, 12, 13, 14, 25)} | {(d, x) for d in (16, 17) for x in ("en", "de")}
    parts = L.stretches(frame(spark, rows), samples).where("doc_id = 16").orderBy("start").collect()
    assert [p.lang for p in parts] == ["en", "de"] and all(0.9 < p.confidence <= 1 for p in parts)


def test_declared(spark):  # noqa: ANN001
    rows = [("pt-BR", "pt"), ("PT_br", "pt"), ("ita", "it"), ("xx", "none"), ("zz-top", "other"), (None, "none"), ("12", "none"), ("english", "other")]
    got = [r[0] for r in spark.createDataFrame(rows, "l string, w string").select(F.coalesce(L.declared(F.col("l")), F.lit("none"))).collect()]
    assert got == [w for _, w in rows]


def test_host_prior_decides_short_texts(spark, samples):  # noqa: ANN001
    """What the text alone leaves open is taken from the site."""
    it = samples.where("lang = 'it'").limit(20).toPandas()["text"]
    rows = [(i, t, "it", "sito.example") for i, t in enumerate(it)] + [(99, "Zelfata Ossvemar", None, "sito.example")]
    last = L.stretches(frame(spark, rows), samples).where("doc_id = 99").collect()
    assert [r.lang for r in last] == ["it"] and last[0].confidence < 1


def test_empty(spark, samples):  # noqa: ANN001
    assert L.stretches(frame(spark, []), samples).collect() == []
    assert L.wrong_labels(frame(spark, []), samples).collect() == []
    assert isinstance(L.fit(samples), L.TextModel) and pd is not None

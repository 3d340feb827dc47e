"""The language of each document and of each stretch in another language.

Evidence is fused by Bayes' rule: the likelihood of the text of every sentence
under each language, the language that the document declares, and the languages
of its address, where counts of a host are smoothed by those of its parent
domains up to the address suffix and the whole collection.  The counts come from
grouped aggregation of a first decision by text alone.  Sentences are then
decoded together, so that a change of language inside a text costs something.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.runtime import join_small, stage

LANGUAGES = ["en", "de", "fr", "es", "it", "pt"]
#: Three-letter codes of the same languages (fixed values).
THREE_LETTER = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt"}
#: Labelled rows that the text model is fitted on, at most.
SAMPLE_ROWS = 100_000
#: Consecutive words that make a stretch in a language count.
MIN_WORDS = 20
#: Pseudo-counts with which a domain leans on its parent domain.
SMOOTHING = 20.0
#: Log odds against a change of language between two sentences.
CHANGE = 8.0
#: Most that one word may add to the log odds; words of unknown spelling less.
WORD_LIMIT, SPELLING_LIMIT = 4.0, 0.7
#: Share of signs of code from which a line is no prose.
CODE_SIGNS = 0.08
_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"[^.!?]+[.!?]*")
_CODE = re.compile(r"[{}()\[\]<>=;_\\|/#$&*^~`\"]")
_CACHE = 400_000


class TextModel:
    """Word and letter-trigram likelihoods, fitted on labelled sentences."""

    def __init__(self, samples: list[tuple[str, str]]):
        words = [{} for _ in LANGUAGES]
        grams = [{} for _ in LANGUAGES]
        for lang, text in samples:
            i = LANGUAGES.index(lang)
            for w in _WORD.findall(text.lower()):
                words[i][w] = words[i].get(w, 0) + 1
                for g in self._grams(w):
                    grams[i][g] = grams[i].get(g, 0) + 1
        self.words = self._table(words, 0.05, WORD_LIMIT)
        self.grams = self._table(grams, 0.5, 2.0)
        self._forget()

    def _forget(self) -> None:
        #: Rows of ``seen`` by word; emptied when _CACHE words are known.
        self.row_of: dict[str, int] = {}
        self.seen = np.zeros((4096, len(LANGUAGES)), np.float32)

    def _rows(self, found: list[str]) -> list[int]:
        get = self.row_of.get
        rows = [get(w, -1) for w in found]
        if -1 in rows:
            for i, w in enumerate(found):
                if rows[i] < 0:
                    at = self.row_of.setdefault(w, len(self.row_of))
                    if at == len(self.seen):
                        self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
                    self.seen[at] = self.evidence(w)
                    rows[i] = at
        return rows

    @staticmethod
    def _grams(word: str) -> list[str]:
        padded = f" {word} "
        return [padded[i : i + 3] for i in range(len(padded) - 2)]

    @staticmethod
    def _table(counts: list[dict], smooth: float, limit: float) -> dict[str, np.ndarray]:
        keys = {k for c in counts for k in c}
        sizes = np.array([sum(c.values()) + smooth * (len(keys) + 1) for c in counts])
        table = {}
        for k in keys:
            p = np.log((np.array([c.get(k, 0) for c in counts]) + smooth) / np.maximum(sizes, 1e-9))
            table[k] = np.maximum(p - p.max(), -limit).astype(np.float32)
        return table

    def evidence(self, word: str) -> np.ndarray:
        """Log likelihood of a word per language, the best one at 0."""
        known = self.words.get(word)
        if known is not None:
            return known
        if any(c.isdigit() for c in word):
            return np.zeros(len(LANGUAGES), np.float32)
        zero = np.zeros(len(LANGUAGES), np.float32)
        total = sum((self.grams.get(g, zero) for g in self._grams(word)), zero)
        return np.maximum(total - total.max(), -SPELLING_LIMIT)

    def sentences(self, text: str) -> tuple[list[int], np.ndarray, list[int]]:
        """Words, likelihoods and first place of each sentence of prose.

        Lines of code or logs give sentences with 0 words.
        """
        counts, places, indices, bounds = [], [], [], []
        if len(self.row_of) > _CACHE:
            self._forget()
        start = 0
        for line in text.split("\n"):
            code = len(_CODE.findall(line)) > CODE_SIGNS * len(line)
            for piece in _PIECE.finditer(line):
                found = _WORD.findall(piece.group().lower())
                if found:
                    places.append(start + piece.start())
                    counts.append(0 if code else len(found))
                    bounds.append(len(indices))
                    if not code:
                        indices += self._rows(found)
            start += len(line) + 1
        if not counts:
            return [], np.zeros((0, len(LANGUAGES)), np.float32), []
        sums = np.zeros((len(indices) + 1, len(LANGUAGES)))
        np.cumsum(self.seen[indices], axis=0, out=sums[1:])
        return counts, (sums[[*bounds[1:], len(indices)]] - sums[bounds]).astype(np.float32), places


def declared(label: Column) -> Column:
    """The language a label names: one of LANGUAGES, ``other`` or ``none``.

    Letter case, blanks and a region suffix don't matter; three-letter codes
    name the same languages.
    """
    base = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)", 1)
    codes = F.create_map(*(F.lit(x) for pair in THREE_LETTER.items() for x in pair))
    code = F.coalesce(F.try_element_at(codes, base), base)
    return F.when(code.isin(LANGUAGES), code).when(F.trim(label).isNull() | (base == "") | base.isin("und", "unknown", "none", "null", "xx", "zxx"), "none").otherwise("other")


def fit(samples: DataFrame) -> TextModel:
    """The text model from labelled rows (lang, text), SAMPLE_ROWS at most."""
    rows = samples.where(F.col("lang").isin(LANGUAGES) & F.col("text").isNotNull()).select("lang", "text")
    return TextModel([(r.lang, r.text) for r in rows.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(SAMPLE_ROWS).collect()])


_FIELDS = "doc_id long, domain string, label string, counts array<int>, evidence array<float>, places array<int>, best string"


def _reader(sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            out = []
            for doc, host, label, text in zip(batch["doc_id"], batch["domain"], batch["label"], batch["text"], strict=True):
                counts, rows, places = model.sentences(text)
                total = rows.sum(axis=0) if counts else np.zeros(len(LANGUAGES))
                lead = np.sort(total)
                best = LANGUAGES[int(total.argmax())] if counts and lead[-1] - lead[-2] > 2 else None
                out.append((doc, host, label, counts, rows.ravel(), places, best))
            yield pd.DataFrame(out, columns=["doc_id", "domain", "label", "counts", "evidence", "places", "best"])

    return run


def _host_priors(first: DataFrame) -> DataFrame:
    """(domain, prior array<double>): languages of each host, smoothed by its
    parent domains down to the suffix and the whole collection."""
    spark = first.sparkSession
    counts = first.where("best IS NOT NULL").groupBy("domain").agg(F.array(*(F.count_if(F.col("best") == lang).cast("double") for lang in LANGUAGES)).alias("n"))
    counts = stage(first.select("domain").distinct().join(counts, "domain", "left").withColumn("n", F.coalesce("n", F.array_repeat(F.lit(0.0), len(LANGUAGES)))))
    # every domain with each of its parents: a.b.c has b.c and c
    parts = F.split("domain", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    up = counts.select("domain", "n", F.posexplode(parents).alias("depth", "parent"))
    total = F.array(*(F.sum(F.col("n")[i]) for i in range(len(LANGUAGES))))
    sums = up.groupBy("parent").agg(total.alias("m"))
    whole = counts.agg(total.alias("m")).first().m
    base = np.array([x or 0.0 for x in whole]) + 1.0
    levels = join_small(up.select("domain", "depth", "parent"), stage(sums), ["parent"])  # a suffix may be that of all hosts
    chain = levels.groupBy("domain").agg(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "m")))).alias("chain"))  # at most as long as the name has parts
    start = F.array(*(F.lit(float(x)) for x in base / base.sum()))
    norm = lambda m: F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    step = lambda prior, level: F.zip_with(level["m"], prior, lambda n, p: (n + p * SMOOTHING) / (norm(level["m"]) + SMOOTHING))
    priors = chain.select("domain", F.aggregate("chain", start, step).alias("prior"))
    return stage(priors.unionByName(spark.createDataFrame([("", [float(x) for x in base / base.sum()])], "domain string, prior array<double>")).dropDuplicates(["domain"]))


def _label_evidence(first: DataFrame) -> dict[str, np.ndarray]:
    """Log P(label | language), counted over the collection."""
    kinds = [*LANGUAGES, "other", "none"]
    rows = first.where("best IS NOT NULL").groupBy("best", "label").count().collect()  # at most 6 x 8 rows
    table = np.full((len(LANGUAGES), len(kinds)), 1.0)
    for r in rows:
        table[LANGUAGES.index(r.best), kinds.index(r.label)] += r["count"]
    table = np.log(table / table.sum(axis=1, keepdims=True))
    return {k: table[:, j] for j, k in enumerate(kinds)}


def _decode(rows: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each sentence and its posterior probability."""
    n, k = rows.shape
    change = np.full((k, k), -CHANGE)
    np.fill_diagonal(change, 0.0)
    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    best, back = rows[0] + prior, np.zeros((n, k), np.int64)
    forward[0] = rows[0] + prior
    for i in range(1, n):
        step = best[:, None] + change
        back[i] = step.argmax(axis=0)
        best = step.max(axis=0) + rows[i]
        reach = forward[i - 1][:, None] + change
        top = reach.max(axis=0)
        forward[i] = top + np.log(np.exp(reach - top).sum(axis=0)) + rows[i]
    for i in range(n - 2, -1, -1):
        reach = change + (rows[i + 1] + backward[i + 1])[None, :]
        top = reach.max(axis=1)
        backward[i] = top + np.log(np.exp(reach - top[:, None]).sum(axis=1))
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    posterior = forward + backward
    posterior = np.exp(posterior - posterior.max(axis=1, keepdims=True))
    return path, (posterior / posterior.sum(axis=1, keepdims=True))[np.arange(n), path]


def _decoder(labels: dict[str, np.ndarray]):  # noqa: ANN202
    """Stretches (lang, words, confidence, start) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, label, counts, evidence, places, prior in zip(batch["doc_id"], batch["label"], batch["counts"], batch["evidence"], batch["places"], batch["prior"], strict=True):
                counts = np.asarray(counts)
                rows = np.asarray(evidence, np.float64).reshape(-1, len(LANGUAGES))
                prose = np.flatnonzero(counts > 0)
                if not len(prose):
                    continue
                path, sure = _decode(rows[prose], counts[prose], np.log(np.asarray(prior)) + labels[label])
                gap = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (np.diff(prose) > 1)]))
                for a, b in zip(gap, np.append(gap[1:], len(path)), strict=True):
                    n = counts[prose[a:b]]
                    out.append((doc, label, LANGUAGES[path[a]], int(n.sum()), float((sure[a:b] * n).sum() / n.sum()), int(places[prose[a]])))
            yield pd.DataFrame(out, columns=["doc_id", "label", "lang", "words", "confidence", "start"])

    return run


def stretches(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, label, lang, words, confidence, start) of every stretch.

    ``documents``: doc_id, text, lang, host; ``samples``: lang, text.  A
    stretch is a run of sentences in one language, not interrupted by lines of
    code or logs; ``start`` counts characters.  ``label`` is what ``lang``
    declares.  Null ids and texts and texts without words give no rows; a null
    host counts as an unknown address; rows given twice come out once.
    """
    sent = documents.sparkSession.sparkContext.broadcast(fit(samples))
    domain = F.coalesce(F.regexp_replace(F.lower(F.trim("host")), r"^\.+|\.+$", ""), F.lit(""))
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", domain.alias("domain"), F.coalesce(declared(F.col("lang")), F.lit("none")).alias("label"), "text")
    first = stage(texts.mapInPandas(_reader(sent), _FIELDS))
    priors = _host_priors(first)
    joined = join_small(first.drop("best"), priors, ["domain"], "left")
    flat = F.array_repeat(F.lit(1.0 / len(LANGUAGES)), len(LANGUAGES))
    joined = joined.withColumn("prior", F.coalesce("prior", flat)).drop("domain")
    return joined.mapInPandas(_decoder(_label_evidence(first)), "doc_id long, label string, lang string, words int, confidence double, start int").distinct()


def document_languages(documents: DataFrame, samples: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, label, lang, words, confidence) of each language in which a
    document has a stretch of ``min_words`` words; words of its longest one."""
    long = stretches(documents, samples).where(F.col("words") >= min_words)
    return long.groupBy("doc_id", "label", "lang").agg(F.max("words").alias("words"), F.max_by("confidence", "words").alias("confidence"))


def wrong_labels(documents: DataFrame, samples: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct (doc_id, lang) of the documents whose label does not name the
    one language of their text; one row per language found."""
    found = stage(document_languages(documents, samples, min_words))
    bad = found.groupBy("doc_id").agg(F.count_distinct("lang").alias("n"), F.count_if(F.col("lang") != F.col("label")).alias("other")).where("n > 1 OR other > 0")
    return found.join(bad, "doc_id", "left_semi").select("doc_id", "lang").distinct()

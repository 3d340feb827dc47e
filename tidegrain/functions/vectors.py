"""Vectors in arrays as column expressions, and a deterministic embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is null, empty, zero, not finite or of
    another dimension."""
    length = norm(a) * norm(b)
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0) & ~F.isnan(length)
    return F.when(fit, F.coalesce(dot(a, b) / length, F.lit(0.0))).otherwise(0.0)


def _token_hash(word: str) -> int:
    """FNV-1a of 32 bits."""
    h = 2166136261
    for byte in word.encode():
        h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
    return h


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Counts of the words of a text by hash, DIMENSIONS of them; null of null."""
    known: dict[str, int] = {}
    for batch in texts:
        out = []
        for text in batch:
            if text is None:
                out.append(None)
                continue
            vector = np.zeros(DIMENSIONS, np.float32)
            for word in text.lower().split():
                at = known.get(word)
                if at is None:
                    at = _token_hash(word) % DIMENSIONS
                    if len(known) < 200_000:
                        known[word] = at
                vector[at] += 1
            out.append(vector)
        yield pd.Series(out)

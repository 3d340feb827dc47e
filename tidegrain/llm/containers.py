"""Texts packed into containers of fixed token capacity.

Every text becomes a hashed vector of its tokens, projected to a few dimensions
and placed on a Hilbert curve, so that texts of similar content are neighbours.
The collection is range-sorted along the curve, and each range is packed as a
stream: best fit over a window of neighbouring texts, longest first, where
containers that stay too empty give their texts to the next window.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.runtime import stage

#: Public byte-level tokenizer for many languages, in the folder of vocabularies.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
TOKENIZERS = "/opt/tokenizers"
#: Dimensions of the projection and bits of each on the curve.
AXES, AXIS_BITS = 4, 8
#: Texts that are packed together, and fullness from which a container is closed.
WINDOW, FULL = 2048, 0.98
#: Times a text may be passed on to the next window.
PASSES = 2
#: Tokens of a range: about this many containers of the largest capacity.
RANGE_CONTAINERS = 500


def hilbert_key(points: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Place along a Hilbert curve of integer points (n, axes) below 2**bits.

    The transform of each point to its transposed index undoes, from the
    highest bit on, the reflections and exchanges of the curve, and the Gray
    code at the end; the bits of the axes are then interleaved.
    """
    x = points.T.astype(np.int64).copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


def _signs(size: int) -> np.ndarray:
    """Random signs of each token id on each axis."""
    return np.random.default_rng(1009).choice(np.array([-1.0, 1.0], np.float32), (size, AXES))


def tokenizer(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _measure(path: str):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        signs = _signs(60_000)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = encode(text)
                if not tokens:
                    continue
                distinct = np.unique(np.array(tokens, np.int64))
                place = signs[distinct % len(signs)].sum(axis=0) / np.sqrt(len(distinct))
                # a standard normal variable in about equal shares on all steps
                steps = (np.tanh(place * 0.8) + 1) / 2 * ((1 << AXIS_BITS) - 1)
                out.append((doc, len(tokens), int(hilbert_key(steps.astype(np.int64)[None])[0])))
            yield pd.DataFrame(out, columns=["doc_id", "tokens", "curve"])

    return run


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens, curve) of each text: its tokens and place on the curve.

    Null ids and texts, and texts without tokens, are left out; of rows with
    the same id the one with the most tokens holds.
    """
    texts = documents.where("doc_id IS NOT NULL AND text != ''").select("doc_id", "text")
    counted = texts.mapInPandas(_measure(path), "doc_id long, tokens int, curve long")
    best = counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "curve")).alias("m"))
    return best.select("doc_id", "m.tokens", "m.curve")


class Packer:
    """Packs a stream of (doc_id, piece_no, tokens) for one capacity."""

    def __init__(self, capacity: int, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.waiting: list[tuple[int, int, int, int]] = []  # tokens, doc_id, piece_no, times passed on

    def add(self, doc: int, piece: int, tokens: int) -> Iterator[list[tuple[int, int, int]]]:
        """Take a text; yields the containers that become full."""
        self.waiting.append((tokens, doc, piece, 0))
        if len(self.waiting) >= 2 * self.window:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Best fit over all waiting texts, longest first."""
        self.waiting.sort(reverse=True)
        containers: list[list[tuple[int, int, int, int]]] = []
        room: list[tuple[int, int]] = []  # room left and container, in order
        for item in self.waiting:
            at = bisect_left(room, (item[0], -1))
            if at < len(room):
                left, number = room.pop(at)
            else:
                left, number = self.capacity, len(containers)
                containers.append([])
            containers[number].append(item)
            if left > item[0]:
                insort(room, (left - item[0], number))
        self.waiting = []
        left_of = dict((number, left) for left, number in room)
        for number, items in enumerate(containers):
            loose = left_of.get(number, 0) > (1 - FULL) * self.capacity and all(x[3] < PASSES for x in items)
            if last or not loose or len(self.waiting) >= self.window:
                yield [(doc, piece, tokens) for tokens, doc, piece, _ in items]
            else:
                self.waiting.extend((tokens, doc, piece, times + 1) for tokens, doc, piece, times in items)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (capacity, curve) to pieces with their container."""
    partition, number = TaskContext.get().partitionId(), 0
    packer, profile = None, None
    columns = ["profile", "capacity_tokens", "container_id", "doc_id", "piece_no", "tokens"]

    def rows(containers: Iterator[list[tuple[int, int, int]]]) -> list[tuple]:
        nonlocal number
        out = []
        for items in containers:
            name = f"{profile}-{partition:06d}-{number:08d}"
            number += 1
            out.extend((profile, packer.capacity, name, *x) for x in items)
        return out

    for batch in batches:
        out = []
        for prof, capacity, doc, tokens in zip(batch["profile"], batch["capacity_tokens"], batch["doc_id"], batch["tokens"], strict=True):
            if packer is None or prof != profile or capacity != packer.capacity:
                if packer is not None:
                    out += rows(packer.flush(True))
                packer, profile = Packer(int(capacity)), prof
            piece = 0
            while tokens > packer.capacity:
                out += rows([[(doc, piece, packer.capacity)]])
                tokens, piece = tokens - packer.capacity, piece + 1
            out += rows(packer.add(doc, piece, tokens))
        yield pd.DataFrame(out, columns=columns)
    if packer is not None:
        yield pd.DataFrame(rows(packer.flush(True)), columns=columns)


def pack(documents: DataFrame, budgets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = TOKENIZER) -> DataFrame:
    """(profile, capacity_tokens, container_id, doc_id, piece_no, tokens).

    ``documents``: doc_id, text; ``budgets``: profile, capacity_tokens; other
    columns are ignored.  Each text is in one container of each profile, as
    piece 0, unless it is longer than the capacity: then its pieces but the
    last fill a container each, in order, and the last is packed like a text.
    Null and empty texts need no container.  Budgets without a positive
    capacity give none; an empty table gives no rows.
    """
    counted = stage(token_counts(documents, os.path.join(folder, vocabulary)))
    sizes = budgets.where("profile IS NOT NULL AND capacity_tokens > 0").select("profile", F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct()
    total, wanted = counted.agg(F.sum("tokens")).first()[0] or 0, sorted((r.capacity_tokens, r.profile) for r in sizes.collect())  # a few settings
    if not total or not wanted:
        return counted.sparkSession.createDataFrame([], "profile string, capacity_tokens int, container_id string, doc_id long, piece_no int, tokens int")
    ranges = max(1, round(total / (wanted[-1][0] * RANGE_CONTAINERS))) * len(wanted)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity_tokens")) for c, p in wanted)))
    spread = counted.select("*", each.alias("s")).select("doc_id", "tokens", "curve", "s.*")
    ordered = spread.repartitionByRange(ranges, "capacity_tokens", "profile", "curve", "doc_id").sortWithinPartitions("capacity_tokens", "profile", "curve", "doc_id")
    return ordered.mapInPandas(_pack, "profile string, capacity_tokens int, container_id string, doc_id long, piece_no int, tokens int")

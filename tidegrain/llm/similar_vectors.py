"""The k most similar vectors of every vector: a forest of sorted hash strings.

Each tree hashes every vector to a long string of sign bits of random
projections and keeps the strings as one sorted array, in which those with the
longest common prefixes lie side by side.  A vector descends in all trees at
once: each tree tells how many others share at least so many bits with it, and
the length at which all trees together reach CANDIDATES is where its synchronous
ascent ends.  In a second reading of the sorted arrays it meets all that share a
prefix of that length with it, compared by rounded vectors of one byte a
component; the best of them are ranked by exact cosine.

Only hash strings travel in the first reading, and strings with rounded vectors
in the second.  Arrays are range-partitioned and read as a stream of blocks, so
no task holds more than a block, however many vectors share a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.runtime import join_small, stage

DIMENSIONS = 64
#: Trees of the forest, bits of a hash string, and the candidates at which the
#: ascent of a vector ends; on one side of a tree it takes no more than these.
TREES, BITS, CANDIDATES = 16, 48, 1500
#: Strings of a sorted array that are read at once.
BLOCK = 1 << 15
#: Members from which on a class of equal vectors is spread over tasks.
HOT_MEMBERS = 1000
#: What a cosine of rounded vectors may be off.
SLACK = 0.005
SEED = 20_240_229


def usable(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, vector) of vectors of ``dimensions`` finite
    components that are not all zero; null ids are left out."""
    big = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = (F.size("vector") == dimensions) & ~big & F.exists("vector", lambda x: x != 0)
    return rows.where("vec_id IS NOT NULL").where(fit).select("vec_id", "vector")


def _planes(tree: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree]).standard_normal((dimensions, BITS))


def _hasher(trees: int, dimensions: int):  # noqa: ANN202
    """Rows (class_id, vector, hashes, rounded): unit vectors, and the sign bits
    of the projections of each tree, first bit highest, so that sorting sorts
    by prefix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.hstack([_planes(t, dimensions) for t in range(trees)]).astype(np.float32)
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if len(batch):
                unit = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                unit /= np.abs(unit).max(axis=1, keepdims=True)
                rounded = np.rint(unit * 127).astype(np.int8)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                bits = (unit.astype(np.float32) @ planes > 0).reshape(len(unit), trees, BITS)
                yield pd.DataFrame({"class_id": batch["class_id"], "vector": list(unit), "hashes": list(bits @ weights), "rounded": [r.tobytes() for r in rounded]})

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of the common prefixes."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _depths(hashes: np.ndarray, ranks: int) -> np.ndarray:
    """For 2^0, 2^1, ... vectors the longest prefix that at least as many others
    share with each, packed in six bits each."""
    n = len(hashes)
    next_ = _shared(hashes[:-1], hashes[1:])
    packed, reached = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in range(BITS, 0, -1):
        ends = np.flatnonzero(np.r_[next_ < level, True]) + 1
        size = np.diff(np.r_[0, ends])
        others = np.repeat(size, size) - 1
        now = np.minimum(np.frexp(others.astype(np.float64))[1], ranks)  # how many of the counts are reached
        more = now > reached
        while more.any():
            packed[more] |= level << (6 * reached[more])
            reached[more] += 1
            more = now > reached
    return packed


def _sorted_blocks(batches: Iterator[pd.DataFrame], block: int, keep: int) -> Iterator[tuple[pd.DataFrame, int]]:
    """Blocks of the sorted array of one tree, and how many of their rows were
    in the block before; ``keep`` rows are carried over."""
    held, rows, old = [], 0, 0
    for batch in batches:
        for tree in pd.unique(batch["tree"]):
            own = batch[batch["tree"] == tree]
            if held and held[-1]["tree"].iloc[0] != tree:
                yield pd.concat(held), old
                held, rows, old = [], 0, 0
            held.append(own)
            rows += len(own)
            if rows - old >= block:
                whole = pd.concat(held)
                yield whole, old
                held = [whole.tail(keep)] if keep else []
                rows = old = len(held[0]) if keep else 0
    if rows > old:
        yield pd.concat(held), old


def _descent(block: int, ranks: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in _sorted_blocks(batches, block, 0):
            yield pd.DataFrame({"class_id": rows["class_id"], "depths": _depths(rows["hash"].to_numpy(), ranks)})

    return run


def _ascent(candidates: int, ranks: int):  # noqa: ANN202
    """(class_id, hashes, rounded, level): the prefix length at which the trees
    together hold enough candidates."""
    step = np.r_[1, np.diff(1 << np.arange(ranks))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            depths = np.stack(batch["depths"].to_numpy())
            levels = ((depths[:, :, None] >> (6 * np.arange(ranks))) & 63).reshape(len(depths), -1)
            order = np.argsort(-levels, axis=1, kind="stable")
            met = np.cumsum(np.tile(step, depths.shape[1])[order], axis=1)
            last = np.minimum((met < candidates).sum(axis=1), levels.shape[1] - 1)
            level = np.take_along_axis(np.take_along_axis(levels, order, 1), last[:, None], 1)[:, 0]
            yield batch.drop(columns="depths").assign(level=level.astype(np.int32))

    return run


def _best(owner: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Which pairs may be among the k most similar of their owner."""
    order = np.lexsort((-sims, owner))
    sorted_ = owner[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    size = np.diff(np.r_[first, len(sorted_)])
    least = sims[order][first + np.minimum(size, k) - 1]
    keep = np.zeros(len(owner), bool)
    keep[order] = sims[order] >= np.repeat(least, size) - 2 * SLACK
    return keep


def _scanner(k: int, floor: float, reach: int, block: int):  # noqa: ANN202
    """Candidate pairs (a, b) of a stream of sorted strings: vectors that share
    the prefix at which the ascent of either ends, nearest in the array first,
    ``reach`` at most on each side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, old in _sorted_blocks(batches, block, reach):
            ids, hashes, level = (rows[c].to_numpy() for c in ("class_id", "hash", "level"))
            unit = np.frombuffer(b"".join(rows["rounded"]), np.int8).reshape(len(rows), -1).astype(np.float32)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            up, down = np.arange(len(ids)), np.arange(max(old, 1), len(ids))  # those still looking onward, and back
            left, right, sims = [], [], []
            for offset in range(1, reach + 1):
                up, down = up[up + offset < len(ids)], down[down >= offset]
                up = up[_shared(hashes[up], hashes[up + offset]) >= level[up]]
                down = down[_shared(hashes[down], hashes[down - offset]) >= level[down]]
                if not len(up) and not len(down):
                    break
                meets = np.zeros(len(ids), bool)
                meets[up[up + offset >= old]] = meets[down - offset] = True
                a = np.flatnonzero(meets)
                sim = np.einsum("ij,ij->i", unit[a], unit[a + offset])
                near = sim >= floor - SLACK
                left.append(a[near])
                right.append(a[near] + offset)
                sims.append(sim[near])
            if left and sum(map(len, left)):
                a, b, sim = np.concatenate(left), np.concatenate(right), np.concatenate(sims)
                keep = _best(np.r_[a, b], np.r_[sim, sim], k)
                keep = keep[: len(a)] | keep[len(a) :]
                x, y = ids[a[keep]], ids[b[keep]]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            x, y = (np.stack(batch[c].to_numpy()) for c in ("v_a", "v_b"))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": np.round((x * y).sum(axis=1), 9)})


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, class_id) and (class_id, vector) of equal vectors."""
    known = stage(vectors.select("vec_id", F.xxhash64("vector").alias("class_id"), "vector"))
    return known.select("vec_id", "class_id").distinct(), known.groupBy("class_id").agg(F.any_value("vector").alias("vector"))


def neighbours(vectors: DataFrame, k: int = 5, floor: float = 0.8, trees: int = TREES, candidates: int = CANDIDATES, block: int = BLOCK, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, other, rank, similarity): the ``k`` most similar of each vector.

    ``vectors``: vec_id long, vector array<float>; unusable ones (see
    ``usable``), null ids and further columns are left out, an empty table
    gives no rows, rows given twice count once.  Only similarities of
    ``floor`` or more count; of equals, to 9 decimals, the smaller vec_id goes
    first.  All vectors are indexed.  Equal vectors form a class that is hashed
    and compared once; each class stands for its k + 1 least members, as no
    other member can be among anyone's first k.
    """
    members, unit = classes(usable(vectors, dimensions))
    members = stage(members)
    ranks = min(candidates.bit_length(), 10)
    parts = max(trees, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = stage(unit.mapInPandas(_hasher(trees, dimensions), "class_id long, vector array<double>, hashes array<long>, rounded binary"))
    unit = hashed.select("class_id", "vector")
    hashed = hashed.drop("vector")
    arrays = lambda rows, *more: rows.select("class_id", *more, F.posexplode("hashes").alias("tree", "hash")).repartitionByRange(parts, "tree", "hash").sortWithinPartitions("tree", "hash", "class_id")
    depths = arrays(hashed).mapInPandas(_descent(block, ranks), "class_id long, depths long")
    depths = depths.groupBy("class_id").agg(F.collect_list("depths").alias("depths"))  # one a tree
    ended = stage(hashed.join(depths, "class_id").mapInPandas(_ascent(candidates, ranks), "class_id long, hashes array<long>, rounded binary, level int"))
    pairs = arrays(ended, "level", "rounded").mapInPandas(_scanner(k, floor, candidates, block), "a long, b long").distinct()
    side = lambda x: unit.select(F.col("class_id").alias(x), F.col("vector").alias(f"v_{x}"))
    scored = stage(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_cosines, "a long, b long, similarity double"))
    both = scored.where(F.col("similarity") >= floor)
    both = both.select(F.col("a").alias("class_id"), F.col("b").alias("other_class"), "similarity").unionAll(both.select("b", "a", "similarity"))
    least = _least_members(members, k + 1)
    own = least.select("class_id", F.col("class_id").alias("other_class"), F.lit(1.0).alias("similarity")).distinct()
    ranked = both.unionAll(own).join(least.withColumnRenamed("class_id", "other_class"), "other_class")
    short = stage(_first(ranked, "class_id", k + 1))  # a class's own list; k + 1, as one of them may be the vector itself
    hot = stage(members.groupBy("class_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT_MEMBERS).select("class_id"))
    n_hot = hot.count()
    joined = join_small(members, hot, ["class_id"], "left_anti", n_hot).join(short, "class_id")
    if n_hot:
        wide = stage(join_small(short, hot, ["class_id"], "left_semi", n_hot))
        joined = joined.unionByName(join_small(members, wide, ["class_id"], rows=n_hot * (k + 1)))
    return _first(joined.where("vec_id != other"), "vec_id", k).select("vec_id", "other", "rank", "similarity")


def _least_members(members: DataFrame, n: int) -> DataFrame:
    """(class_id, other) of the n least members of each class; partial lists
    first, so a class of a third of all rows is never in one task."""
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    cut = lambda c: F.slice(F.sort_array(c), 1, n)
    some = salted.groupBy("class_id", "_salt").agg(cut(F.collect_list("vec_id")).alias("ids"))
    return some.groupBy("class_id").agg(cut(F.flatten(F.collect_list("ids"))).alias("ids")).select("class_id", F.explode("ids").alias("other"))


def _first(rows: DataFrame, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def similar_pairs(vectors: DataFrame, **options: int) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b, where one is among the other's most
    similar; see ``neighbours``."""
    near = neighbours(vectors, **options)
    return near.select(F.least("vec_id", "other").alias("id_a"), F.greatest("vec_id", "other").alias("id_b")).distinct()

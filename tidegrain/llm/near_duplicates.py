"""Pairs of records whose word sets are nearly the same.

Size-aware heavy-light join.  The similarity bounds the number D of words that
two sets of given sizes may differ in.  The vocabulary is hashed into D + 2
parts, so at least two parts hold exactly the same words in both sets.  Small
sets enumerate fixed-size subsets of their parts: every single part, and for
parts whose words stand alike in many sets every pair of such parts, and meet
where a subset is equal; sets of a pair that very many share meet in blocks, so
no task holds them all.  For large sets that would be too many; they scan the
inverted lists of the words of their prefix, rarest words first, instead.  The
boundary between small and large is the size at which the estimated cost of both
ways together is least.  A bitmap of each set travels with it, so most pairs
that are too different are seen to be before they are moved any further.

Subsets of parts stand in for subsets of single words, because in a small
vocabulary every affordable subset of words is held by a fixed share of all
sets, and the lists would grow with the collection.

Records with equal word sets form a class and are joined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.operators.graphs import components
from tidegrain.runtime import join_small, stage

#: Sets that may share a part before it is taken in pairs with other parts, and
#: how many times as many may share a pair before they meet in blocks.
FEW, BLOCK_FEW = 256, 16
#: Shared-word counts of at most this many words are sent to all executors (12
#: bytes a word); beyond it they are joined by a shuffle.
BROADCAST_WORDS = 2_000_000
#: Words looked at together in a worker.
_SLICE = 400_000


def word_list(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of unsigned longs."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def size_levels(largest: int, threshold: float) -> np.ndarray:
    """Upper ends of size intervals; sets that may be similar lie in the same
    interval or in neighbouring ones."""
    ends, start = [0], 1
    while ends[-1] < largest:
        ends.append(int(np.floor(start / threshold + 1e-9)))
        start = ends[-1] + 1
    return np.array([*ends, int(np.floor(start / threshold + 1e-9))])


def _differing(size: np.ndarray, threshold: float) -> np.ndarray:
    """Most words in which two similar sets of at most ``size`` words differ."""
    return np.floor((1 - threshold) / (1 + threshold) * 2 * size + 1e-9).astype(np.int64)


def _slices(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Parts of a batch with their words in one array and the set of each."""
    ends = batch["size"].cumsum().to_numpy()
    for part in np.array_split(np.arange(len(batch)), max(1, int(ends[-1]) // _SLICE) if len(batch) else 1):
        if len(part):
            rows = batch.iloc[part]
            yield rows, np.concatenate(rows["words"].to_numpy()).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(rows)), rows["size"])


def _bitmaps(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two longs in which each word of a set sets a bit of one."""
    spread = _mix(words, 7)
    bit, high = np.uint64(1) << (spread & np.uint64(63)), (spread >> np.uint64(6)) & np.uint64(1)
    return [np.bitwise_or.reduceat(np.where(high == half, bit, np.uint64(0)), first).view(np.int64) for half in (0, 1)]


def _part_keys(levels: np.ndarray, threshold: float):  # noqa: ANN202
    """Rows (key, class_id, sized, b0, b1): the words of each part, at the level
    of the set's own size and at the next one.  ``sized`` is twice the size,
    and one more at its own level.

    Keys are odd for empty parts.  Two empty parts say nothing, so they are no
    pair; similar sets whose equal parts are all empty have D parts with words
    at most, and such sets have a second, even key for each empty part.
    """
    parts = _differing(levels, threshold) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, words, of in _slices(batch):
                size = rows["size"].to_numpy()
                b0, b1 = _bitmaps(words, np.cumsum(size) - size)
                own_level = np.searchsorted(levels, size)
                for up in (0, 1):
                    level = own_level + up
                    n = parts[level]
                    first = np.cumsum(n) - n
                    part = (_mix(words, 11) % n[of].astype(np.uint64)).astype(np.int64)
                    content = np.zeros(int(n.sum()), np.uint64)
                    np.add.at(content, first[of] + part, _mix(words, 13))
                    set_of = np.repeat(np.arange(len(rows)), n)
                    number = np.arange(len(content)) - first[set_of]
                    key = _mix(content ^ _mix((level[set_of] * 100_003 + number).astype(np.uint64), 17), 19)
                    empty = content == 0
                    sparse = empty & (np.bincount(set_of, ~empty, len(rows)) <= n - 2)[set_of]
                    key = np.r_[key & ~np.uint64(1) | empty, _mix(key[sparse], 23) & ~np.uint64(1)]
                    of_set = np.r_[set_of, set_of[sparse]]
                    yield pd.DataFrame({
                        "key": key.view(np.int64), "class_id": rows["class_id"].to_numpy()[of_set], "sized": (size.astype(np.int64) * 2 + (1 - up))[of_set], "b0": b0[of_set], "b1": b1[of_set],
                    })

    return run


def _similar_enough(threshold: float) -> Column:
    """What two sets a, b of sizes and bitmaps fulfil if they are similar."""
    a, b = (F.shiftright(f"sized_{x}", 1) for x in "ab")
    fits = (a >= b * threshold - 1e-9) & (b >= a * threshold - 1e-9)
    bits = F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))) + F.bit_count(F.col("b1_a").bitwiseXOR(F.col("b1_b")))
    return fits & (bits <= (a + b) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def _meet(left: DataFrame, right: DataFrame, threshold: float, also: Column) -> DataFrame:
    """Distinct class pairs that share a key and may be similar."""
    side = lambda rows, x: rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "key"))
    pairs = side(left, "a").join(side(right, "b"), "key").where(also & _similar_enough(threshold))
    return pairs.select(F.least("class_id_a", "class_id_b").alias("a"), F.greatest("class_id_a", "class_id_b").alias("b")).distinct()


def _heavy(made: DataFrame, few: int) -> tuple[DataFrame, int]:
    """The keys of more than ``few`` rows, with their rows, and how many."""
    heavy = stage(made.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > few))
    return heavy, heavy.count()


def _blocks(many: DataFrame, heavy: DataFrame, n_heavy: int, block: int) -> DataFrame:
    """Rows of heavy keys, once for every pair of blocks of about ``block`` sets
    that theirs is in, so that no task holds all sets of a key."""
    own = join_small(many, heavy, ["key"], rows=n_heavy).withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(many.columns)


def _small_pairs(sets: DataFrame, largest: int, threshold: float, few: int) -> DataFrame:
    """Candidate pairs of sets by equal subsets of parts."""
    columns = ["key", "class_id", "sized", "b0", "b1"]
    made = sets.mapInPandas(_part_keys(size_levels(largest, threshold), threshold), "key long, class_id long, sized long, b0 long, b1 long")
    order = (F.col("class_id_a") < F.col("class_id_b")) & (F.col("sized_a").bitwiseOR(F.col("sized_b")) % 2 == 1)
    heavy, n = _heavy(made, few)
    light = join_small(made, heavy.select("key"), ["key"], "left_anti", n)
    pairs = _meet(light, light, threshold, order)  # FEW rows a key at most
    if not n:
        return pairs
    many = join_small(made, heavy.select("key"), ["key"], "left_semi", n)
    # the parts of one set at one level, as many as D + 2 and the second keys
    held = many.groupBy(*columns[1:]).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    firsts = held.select("*", F.posexplode("keys").alias("i", "k1"))
    both = firsts.select(*columns[1:], "k1", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("k2"))
    double = both.where("(k1 & k2 & 1) = 0").select(F.xxhash64("k1", "k2").alias("key"), *columns[1:])
    double = stage(double)
    heavy, n = _heavy(double, few * BLOCK_FEW)
    light = join_small(double, heavy.select("key"), ["key"], "left_anti", n)
    pairs = pairs.unionAll(_meet(light, light, threshold, order))
    if n:
        spread = _blocks(join_small(double, heavy.select("key"), ["key"], "left_semi", n), heavy, n, few * BLOCK_FEW)
        pairs = pairs.unionAll(_meet(spread, spread, threshold, order))
    return pairs


def _prefixes(ranked: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Per set: the shared words of its prefix, and what both ways would cost."""
    for batch in ranked:
        need = np.ceil(threshold * batch["size"].to_numpy() - 1e-9).astype(np.int64)
        size = batch["size"].to_numpy()
        out, costs = [], []
        for words, counts, length in zip(batch["words"], batch["counts"], (size - need + 1).tolist(), strict=True):
            counts = np.asarray(counts)
            at = np.lexsort((words, counts))[:length]
            at = at[counts[at] > 1]
            out.append(np.asarray(words)[at])
            costs.append(int(counts[at].sum()))
        subsets = 2 * (_differing(np.floor(size / threshold), threshold) + 2)
        yield pd.DataFrame({"class_id": batch["class_id"], "size": size, "prefix": out, "subset_cost": subsets, "list_cost": costs})


def _with_prefixes(sets: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Sets with the shared words of their prefix in order of rarity."""
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = stage(counts.select("word", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")))
    schema = "class_id long, size int, prefix array<long>, subset_cost long, list_cost long"
    if counts.count() <= limit:
        shared = counts.toPandas()
        by_word = np.argsort(shared["word"].to_numpy())
        sent = sets.sparkSession.sparkContext.broadcast((shared["word"].to_numpy()[by_word], shared["n"].to_numpy()[by_word]))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, n = sent.value
            for batch in batches:
                for rows, flat, of in _slices(batch):
                    flat = flat.view(np.int64)
                    at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
                    found = np.where(words[at] == flat, n[at], 1) if len(words) else np.ones(len(flat), np.int32)
                    yield rows.assign(counts=np.split(found, np.flatnonzero(np.diff(of)) + 1))

        return sets.mapInPandas(lambda b: _prefixes(look_up(b), threshold), schema)
    exploded = sets.select("class_id", "size", F.explode("words").alias("word"))
    salted = join_small(exploded, counts, ["word"], "left", limit=0)
    pair = F.collect_list(F.struct("word", F.coalesce("n", F.lit(1)).alias("n")))
    grouped = salted.groupBy("class_id", "size").agg(pair.alias("p")).select("class_id", "size", F.col("p.word").alias("words"), F.col("p.n").alias("counts"))
    return grouped.mapInPandas(lambda b: _prefixes(b, threshold), schema)


def _boundary(prefixes: DataFrame) -> int:
    """The largest size that enumerates subsets, by least estimated cost."""
    costs = prefixes.groupBy("size").agg(F.sum(F.col("subset_cost").cast("double")), F.sum(F.col("list_cost").cast("double"))).collect()
    costs = sorted(tuple(r) for r in costs)  # one row per distinct set size
    best, at = sum(heavy for _, _, heavy in costs), 0
    total = best
    for size, light, heavy in costs:
        total += light - heavy
        if total <= best:
            best, at = total, size
    return at


def _with_bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for rows, words, _ in _slices(batch):
            b0, b1 = _bitmaps(words, (rows["size"].cumsum() - rows["size"]).to_numpy())
            yield pd.DataFrame({"class_id": rows["class_id"], "b0": b0, "b1": b1})


def similar_classes(sets: DataFrame, threshold: float = 0.8, broadcast_words: int = BROADCAST_WORDS, few: int = FEW, boundary: int | None = None) -> DataFrame:
    """Pairs (a, b, a < b) of classes with Jaccard similarity >= threshold.

    ``sets``: class_id long, size int, words array<long> (distinct, hashed, at
    least one); a class given twice counts once.  ``boundary`` is chosen by
    cost if it is not given.
    """
    prefixes = stage(_with_prefixes(sets, threshold, broadcast_words))
    at = _boundary(prefixes) if boundary is None else boundary
    pairs = _small_pairs(sets.where(F.col("size") <= at), at, threshold, few)
    if not prefixes.where(F.col("size") > at).isEmpty():
        reach = int(np.floor(threshold * (at + 1)))
        long = sets.where(F.col("size") >= reach)
        bits = long.mapInPandas(_with_bitmaps, "class_id long, b0 long, b1 long")
        lists = prefixes.where(F.col("size") >= reach).join(bits, "class_id").select(F.explode("prefix").alias("key"), "class_id", (F.col("size") * 2).cast("long").alias("sized"), "b0", "b1")
        pairs = pairs.unionAll(_meet(lists, lists.where(F.col("sized") > 2 * at), threshold, F.col("class_id_a") != F.col("class_id_b")))
    pairs = stage(pairs.distinct())
    members = stage(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct())
    used = join_small(sets, members, ["class_id"], "left_semi", limit=BROADCAST_WORDS)
    side = lambda name: used.select(F.col("class_id").alias(name), F.col("words").alias(f"words_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    union = F.size("words_a") + F.size("words_b") - shared
    return both.where(shared >= union * threshold - 1e-9).select("a", "b")


def word_sets(records: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(entity, id, class_id) of all records of at least ``min_words`` distinct
    words, and (class_id, size, words) of their distinct word sets."""
    words = F.transform(F.array_distinct(word_list(F.col("text"))), lambda w: F.xxhash64(F.col("entity"), w))
    hashed = records.where("text IS NOT NULL AND id IS NOT NULL").select("entity", "id", F.array_sort(words).alias("words"))
    hashed = hashed.where(F.size("words") >= max(1, min_words)).withColumn("class_id", F.xxhash64("words"))
    rows = stage(hashed.withColumn("row", F.monotonically_increasing_id()))
    copied = stage(rows.groupBy("class_id").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1").select("class_id", "kept"))
    extra = stage(join_small(rows.select("row", "class_id"), copied, ["class_id"]).where("row != kept").select("row"))
    sets = join_small(rows, extra, ["row"], "left_anti").select("class_id", F.size("words").alias("size"), "words")
    return rows.select("entity", "id", "class_id").distinct(), sets


def _all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of different ids within each class and between similar ones."""
    links = pairs.unionByName(members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    a = members.select("entity", F.col("class_id").alias("a"), F.col("id").alias("id_a"))
    b = members.select(F.col("class_id").alias("b"), F.col("id").alias("id_b"))
    linked = join_small(join_small(links, a, ["a"]), b, ["b"]).where("a != b OR id_a < id_b")
    linked = linked.select("entity", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return linked.where("id_a != id_b").distinct()


def similar_records(records: DataFrame, threshold: float = 0.8, min_words: int = 20, broadcast_words: int = BROADCAST_WORDS, few: int = FEW, boundary: int | None = None, expand: int | None = None) -> DataFrame:
    """Distinct (entity, id_a, id_b), id_a < id_b, of similar records: all pairs.

    ``records``: entity string, id long, text string; other columns are
    ignored.  Null texts and texts of fewer than ``min_words`` distinct words
    are no records; rows given twice count once; of records given with several
    texts each text counts.  An empty table gives no rows.  Pairs are between
    records of the same entity.  Only with ``expand`` given, records of equal
    word sets being a class, members of classes of more than ``expand`` are
    paired with the least member alone, of their own and of similar classes;
    ``similar_groups`` gives the membership in a size that follows the records.
    """
    members, sets = word_sets(records, min_words)
    members = stage(members)
    pairs = stage(similar_classes(sets, threshold, broadcast_words, few, boundary))
    if expand is None:
        return _all_pairs(members, pairs)
    multiple = stage(members.groupBy("class_id").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"))
    known = join_small(members, multiple, ["class_id"], "left").select("entity", "id", "class_id", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("least", "id").alias("least"))
    known = stage(known)
    side = lambda x: known.select("entity", F.col("class_id").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("least").alias(f"least_{x}"))
    a, b = side("a"), side("b").drop("entity")
    shown = lambda x: F.expr(f"n_{x} <= {expand} OR id_{x} = least_{x}")
    linked = pairs.join(a.where(shown("a")), "a").join(b.where(shown("b")), "b").select("entity", "id_a", "id_b")
    for x, y, s, t in (("a", "b", a, b), ("b", "a", b, a)):  # a large class's other members, each with the least one of the other class
        rest = pairs.join(s.where(~shown(x)), x).join(t.where(f"id_{y} = least_{y}"), y)
        linked = linked.unionByName(rest.select("entity", "id_a", "id_b"))
    linked = linked.select("entity", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    own = known.where(f"n > 1 AND n <= {expand}").groupBy("entity", "class_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    own = own.select("entity", F.posexplode("ids").alias("i", "id_a"), "ids").select("entity", "id_a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("id_b"))
    star = known.where(f"n > {expand} AND id != least").select("entity", F.col("least").alias("id_a"), F.col("id").alias("id_b"))
    return linked.unionByName(own).unionByName(star).where("id_a != id_b").distinct()


def similar_groups(records: DataFrame, threshold: float = 0.8, min_words: int = 20, **options: int) -> DataFrame:
    """(entity, id, group_id, links): every record that is similar to another.

    Groups are the connected components of similarity, named by their least id;
    ``links`` counts the records that one is similar to.  One row a record, so
    the size follows the records and not their pairs; records given with
    several texts count as of each text.  See ``similar_records``.
    """
    members, sets = word_sets(records, min_words)
    members = stage(members)
    pairs = stage(similar_classes(sets, threshold, **options))
    sizes = stage(members.groupBy("class_id").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes.select(F.col("class_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("near"))
    known = sizes.join(near, "class_id", "left").join(components(pairs).withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.select("class_id", "least", F.coalesce("component", "class_id").alias("component"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links")).where("links > 0")
    known = stage(known)
    named = known.groupBy("component").agg(F.min("least").alias("group_id"))
    classes = stage(known.join(named, "component").select("class_id", "group_id", "links"))
    rows = join_small(members, classes, ["class_id"])
    return rows.groupBy("entity", "id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))

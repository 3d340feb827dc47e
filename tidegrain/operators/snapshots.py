"""What changed between consecutive full snapshots of a keyed table.

Each snapshot becomes one invertible Bloom lookup table per hash bucket of the
record keys.  The tables of two neighbouring snapshots are subtracted, which
cancels every record that is alike in both, and the rest is peeled.  Buckets
that cannot be peeled are encoded again with twice the cells, and divided when
their tables grow large.  The recovered key hashes are looked up in the snapshots, compared value by value and
classified.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.runtime import BROADCAST_ROWS, stage

#: Records that a hash bucket holds on average, and the cells of one of its
#: three subtables in the first pass; each later pass doubles the cells.
BUCKET_ROWS = 2_000
FIRST_CELLS = 256
#: Cells of a subtable beyond which a bucket is divided instead, into how many,
#: and passes after which decoding is given up with an error.
MOST_CELLS, DIVIDE, PASSES = 1 << 14, 16, 64
#: Bits of the pair hash that choose a cell in each subtable.
_BITS = 20
_MASK = (1 << _BITS) - 1


def _pair_hash(k1: int, k2: int, value: int, salt: int) -> int:
    """Spark's xxhash64(k1, k2, value, salt) of four longs."""
    seed = 42
    for x in (k1, k2, value, salt):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return seed


def _peel(cells: pd.DataFrame, size: int, salt: int) -> list[tuple[int, int, int, int]] | None:
    """The signed pairs of one subtracted table, or None if it won't decode."""
    count = dict(zip(cells["cell"].tolist(), cells["n"].tolist(), strict=True))
    xors = {
        c: [a, b, v, p]
        for c, a, b, v, p in zip(cells["cell"].tolist(), cells["x1"].tolist(), cells["x2"].tolist(), cells["xv"].tolist(), cells["xp"].tolist(), strict=True)
    }
    found: list[tuple[int, int, int, int]] = []
    open_cells = [c for c, n in count.items() if n in (1, -1)]
    while open_cells:
        cell = open_cells.pop()
        sign = count[cell]
        k1, k2, value, pair = xors[cell]
        if sign not in (1, -1) or _pair_hash(k1, k2, value, salt) != pair & 0xFFFFFFFFFFFFFFFF:
            continue
        found.append((k1, k2, value, sign))
        unsigned = pair & 0xFFFFFFFFFFFFFFFF
        for i in range(3):
            at = i * size + ((unsigned >> (i * _BITS)) & _MASK) % size
            count[at] = count.get(at, 0) - sign
            have = xors.setdefault(at, [0, 0, 0, 0])
            for j, x in enumerate((k1, k2, value, pair)):
                have[j] ^= x
            if count[at] in (1, -1):
                open_cells.append(at)
    if any(count.values()) or any(any(x) for x in xors.values()):
        return None
    return found


def _peeler(size: int, salt: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        pairs = _peel(cells, size, salt)
        rows = [(0, 0, 0)] if pairs is None else [(k1, k2, sign) for k1, k2, _, sign in pairs]
        out = pd.DataFrame(rows, columns=["k1", "k2", "sign"], dtype=np.int64)
        out.insert(0, "bucket", int(key[1]))
        out.insert(0, "transition", int(key[0]))
        return out

    return run


def sketch(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """The lookup tables of each snapshot: (snapshot_no, bucket, cell, n, x1,
    x2, xv, xp) of rows (snapshot_no, bucket, k1, k2, value).

    Tables of the same buckets, size and salt are added by summing n and xoring
    the rest, and can be kept with the snapshot.
    """
    pair = F.xxhash64("k1", "k2", "value", F.lit(salt).cast("long"))
    cells = F.array(*(F.lit(i * size) + F.shiftrightunsigned("pair", i * _BITS).bitwiseAND(F.lit(_MASK)) % F.lit(size) for i in range(3)))
    keyed = rows.withColumn("pair", pair).withColumn("cell", F.explode(cells))
    return keyed.groupBy("snapshot_no", "bucket", "cell").agg(
        F.count("*").alias("n"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"), F.bit_xor("value").alias("xv"), F.bit_xor("pair").alias("xp")
    )


def subtract(tables: DataFrame) -> DataFrame:
    """Tables of each snapshot less those of the one before, by transition;
    equal records cancel.  Empty cells are left out."""
    ways = F.explode(F.array(F.struct(F.col("snapshot_no").alias("transition"), F.lit(1).alias("sign")), F.struct((F.col("snapshot_no") + 1).alias("transition"), F.lit(-1).alias("sign"))))
    signed = tables.select("*", ways.alias("way"))
    return (
        signed.groupBy(F.col("way.transition").alias("transition"), "bucket", "cell")
        .agg(F.sum(F.col("n") * F.col("way.sign")).alias("n"), *(F.bit_xor(x).alias(x) for x in ("x1", "x2", "xv", "xp")))
        .where("n != 0 OR x1 != 0 OR x2 != 0 OR xv != 0 OR xp != 0")
    )


def snapshot_changes(
    states: DataFrame,
    payload: list[str],
    digest: list[Column],
    differs: Callable[[str, str], Column],
    bucket_rows: int = BUCKET_ROWS,
    first_cells: int = FIRST_CELLS,
) -> DataFrame:
    """Added, removed and changed records of each snapshot against the one before.

    ``states``: one row per (``snapshot_no`` int, ``record_key`` string) with
    the columns ``payload``; other columns are left out, so they may have any
    name.  ``digest``: columns that are equal whenever a record is certainly
    unchanged.  ``differs(old, new)``: a condition over the two payload structs
    of those names; it decides, the digest only proposes.

    Rows with a null key or snapshot number are no records.  Snapshot numbers
    are compared with the number one less, also if a number in between has no
    rows (all its records are then removed, and come back as added).  An empty
    table or a single snapshot has no changes.  Of rows with the same snapshot
    and key the one with the greatest payload holds (see ``latest_states`` for
    other orders).

    Returns ``snapshot_no``, ``record_key``, ``change_kind``.
    """
    spark = states.sparkSession
    known = states.where(F.col("record_key").isNotNull() & F.col("snapshot_no").isNotNull())
    known = known.groupBy("snapshot_no", "record_key").agg(F.max(F.struct(*payload)).alias("payload"))
    rows = known.select("snapshot_no", "record_key", "payload", *(F.col(f"payload.{c}").alias(c) for c in payload)).select(
        "snapshot_no", "record_key", "payload",
        F.xxhash64("record_key").alias("k1"), F.xxhash64(F.lit("second"), "record_key").alias("k2"),
        F.xxhash64(*digest).alias("value"),
    )
    rows = stage(rows)
    total, first, last, snapshots = rows.agg(F.count("*"), F.min("snapshot_no"), F.max("snapshot_no"), F.count_distinct("snapshot_no")).first()
    result = "snapshot_no int, record_key string, change_kind string"
    if not total or first == last:
        return spark.createDataFrame([], result)
    buckets = max(1, -(-total // (bucket_rows * snapshots)))
    keyed = rows.select("snapshot_no", "k1", "k2", "value")
    size, salt, open_buckets, decoded = first_cells, 0, None, []
    while True:
        part = keyed.withColumn("bucket", F.pmod("k1", F.lit(buckets)))
        if open_buckets is not None:
            ways = open_buckets.select("bucket", F.explode(F.array("transition", F.col("transition") - 1)).alias("snapshot_no")).distinct()
            part = part.join(ways, ["bucket", "snapshot_no"], "left_semi")
        cells = subtract(sketch(part, size, salt)).where(F.col("transition").between(first + 1, last))
        if open_buckets is not None:
            cells = cells.join(open_buckets, ["transition", "bucket"], "left_semi")
        out = stage(cells.groupBy("transition", "bucket").applyInPandas(_peeler(size, salt), "transition int, bucket long, k1 long, k2 long, sign long"))
        decoded.append(out.where("sign != 0").drop("bucket"))
        open_buckets = out.where("sign = 0").select("transition", "bucket")
        if open_buckets.isEmpty():
            break
        size, salt = size * 2, salt + 1
        if salt >= PASSES:
            raise RuntimeError(f"lookup tables that could not be decoded in {PASSES} passes")
        if size > MOST_CELLS:  # a residue class of keys is the union of its finer ones
            open_buckets = open_buckets.select("transition", F.explode(F.transform(F.sequence(F.lit(0), F.lit(DIVIDE - 1)), lambda i: F.col("bucket") + i.cast("long") * buckets)).alias("bucket"))
            buckets, size = buckets * DIVIDE, max(MOST_CELLS // DIVIDE, 1)
    recovered = stage(reduce(DataFrame.unionAll, decoded).select("transition", "k1", "k2").distinct())
    here = rows.select("k1", "k2", "record_key", "payload", "snapshot_no")
    # beyond the bound both sides are shuffled: a key has one row a snapshot
    sides = here.join(F.broadcast(recovered) if recovered.count() <= BROADCAST_ROWS else recovered, ["k1", "k2"]).where("snapshot_no IN (transition, transition - 1)")
    new = F.col("snapshot_no") == F.col("transition")
    both = sides.groupBy(F.col("transition").alias("snapshot_no"), "record_key").agg(
        F.max(F.when(~new, 1)).alias("in_old"), F.max(F.when(new, 1)).alias("in_new"),
        F.any_value(F.when(~new, F.col("payload")), True).alias("old"), F.any_value(F.when(new, F.col("payload")), True).alias("new"),
    )
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(differs("old", "new"), "changed")
    return both.select(F.col("snapshot_no").cast("int").alias("snapshot_no"), "record_key", kind.alias("change_kind")).where("change_kind IS NOT NULL")


def latest_states(rows: DataFrame, order: list[str], payload: list[str]) -> DataFrame:
    """One row per (snapshot_no, record_key): the greatest by ``order``.

    Nulls order first; among equal orders the greatest payload holds, so
    repeated rows and ties give the same result on every run.
    """
    best = F.max(F.struct(*order, *payload)).alias("best")
    return rows.groupBy("snapshot_no", "record_key").agg(best).select("snapshot_no", "record_key", *(F.col(f"best.{c}").alias(c) for c in payload))


def _clean_key(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def _ratio_digest(column: str) -> Column:
    """Ratios with the same digest are less than 1e-6 apart (or both null or NaN)."""
    return F.when(F.col(column).isNull(), "null").otherwise(F.round(F.col(column), 6).cast("string"))


def _ratio_differs(old: Column, new: Column) -> Column:
    same = (old.isNull() & new.isNull()) | (F.isnan(old) & F.isnan(new)) | (old == new) | (F.abs(old - new) < 1e-6)
    return ~F.coalesce(same, F.lit(False))


def document_changes(snapshots: DataFrame, **sizes: int) -> DataFrame:
    """Changes of documents by url; see ``snapshot_changes``.

    The url is trimmed and lower-cased; a null or blank one is no record.  Of
    several rows the one with the latest ``updated_at`` holds.  Changed means
    stable_ratio, novelty_ratio or changed_recently differs, where null equals
    null, NaN equals NaN and ratios less than 1e-6 apart are equal.
    """
    payload = ["stable_ratio", "novelty_ratio", "changed_recently"]
    keyed = snapshots.select("snapshot_no", _clean_key("url").alias("record_key"), "updated_at", "delivered_at", *payload).where("record_key != ''")

    def differs(old: str, new: str) -> Column:
        ratios = [_ratio_differs(F.col(f"{old}.{c}"), F.col(f"{new}.{c}")) for c in payload[:2]]
        return ratios[0] | ratios[1] | ~F.col(f"{old}.changed_recently").eqNullSafe(F.col(f"{new}.changed_recently"))

    digest = [_ratio_digest("stable_ratio"), _ratio_digest("novelty_ratio"), F.coalesce(F.col("changed_recently").cast("string"), F.lit("null"))]
    return snapshot_changes(latest_states(keyed, ["updated_at", "delivered_at"], payload), payload, digest, differs, **sizes)


def fingerprint_changes(records: DataFrame, **sizes: int) -> DataFrame:
    """Changes of the fingerprints of documents; see ``snapshot_changes``.

    The key is document_id, ``/`` and the fingerprint trimmed and lower-cased;
    rows where either is null or the fingerprint is blank are no records.  The
    row saved last holds.  Changed means heading_path differs in any element or
    in order; null differs from an empty path.
    """
    clean = _clean_key("fingerprint")
    key = F.when(clean != "", F.concat(F.col("document_id").cast("string"), F.lit("/"), clean))
    keyed = records.select("snapshot_no", key.alias("record_key"), "saved_at", "heading_path").where("record_key IS NOT NULL")

    def differs(old: str, new: str) -> Column:
        return ~F.col(f"{old}.heading_path").eqNullSafe(F.col(f"{new}.heading_path"))

    digest = [F.coalesce(F.to_json("heading_path"), F.lit("null"))]
    return snapshot_changes(latest_states(keyed, ["saved_at"], ["heading_path"]), ["heading_path"], digest, differs, **sizes)

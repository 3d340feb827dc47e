"""Numbers, conditions, times and identifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 if the whole is 0 or null."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def steps(x: Column, *bounds: tuple[float, float], otherwise: float = 0.0) -> Column:
    """The value of the first bound that x reaches; bounds fall."""
    first, *rest = bounds
    chain = F.when(x >= first[0], first[1])
    return reduce(lambda c, b: c.when(x >= b[0], b[1]), rest, chain).otherwise(otherwise)


def given(condition: Column, value: float) -> Column:
    """The value where the condition holds, else 0."""
    return F.when(condition, value).otherwise(0.0)


def first_filled(*columns: Column) -> Column:
    """The first that is not blank, trimmed; null if all are."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def lenient_int(text: Column) -> Column:
    """The leading integer of a text, 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.trim(text), r"^([+-]?\d{1,18})", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def recency(at: Column, as_of: Column) -> Column:
    """.12 within a day before ``as_of``, .08 within a week, .04 within 30 days."""
    age = F.timestamp_diff("SECOND", at, as_of) / 86400.0
    return F.when(age.isNull(), 0.0).when(age <= 1, 0.12).when(age <= 7, 0.08).when(age <= 30, 0.04).otherwise(0.0)


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix, ``_`` and 16 hex digits of the SHA-256 of the parts joined by NUL."""
    joined = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def piped_id(prefix: str, *parts: Column) -> Column:
    """As ``content_id`` with the parts trimmed and joined by ``|``."""
    joined = F.concat_ws("|", *(F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def findings(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for holds, name in rules)))


def merged_map(old: Column, new: Column) -> Column:
    """Both maps; of a key in both the new value holds if it is not blank."""
    filled = F.map_filter(new, lambda _, v: F.trim(v) != "")
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(filled, k))
    return F.map_concat(kept, filled)

"""Keys under which a string meets every string that contains it, so that containment is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a string is looked up under its first so many characters, the most that it has
TIERS = (8, 3, 1)


def lookup_key(short: Column) -> Column:
    """The key of a non-empty string that may be contained in others."""
    n = F.length(short)
    key = F.substring(short, 1, TIERS[-1])
    for t in reversed(TIERS[:-1]):
        key = F.when(n >= t, F.substring(short, 1, t)).otherwise(key)
    return key


def _runs(text: Column, size: int) -> Column:
    """Every run of ``size`` characters; none of a shorter text."""
    n = F.length(text)
    found = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= size, found).otherwise(F.array().cast("array<string>"))


def offered_keys(long: Column, tiers: tuple[int, ...] = TIERS) -> Column:
    """The keys of all strings that ``long`` contains: every run of characters as long as a tier."""
    return F.array_distinct(F.concat(*(_runs(long, t) for t in tiers)))

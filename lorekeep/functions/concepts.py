"""Concept names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.whitespace import collapse_ws, trim_ws


def normalize_concept(c: Column) -> Column:
    """Key of a concept name: lower case, single spaces, no bracketed addition, straight quotes, no final full stop.

    Null stays null; a name that is only a bracketed addition becomes the empty string.
    """
    s = collapse_ws(F.lower(trim_ws(c)))
    s = F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, "['’´`]", "'")
    s = trim_ws(collapse_ws(s))
    return trim_ws(F.regexp_replace(s, r"\.\z", ""))

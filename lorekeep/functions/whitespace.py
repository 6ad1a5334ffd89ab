"""White space as ECMAScript sees it: the JVM's ``\\s`` and Spark's ``trim`` leave the no-break space and its kin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the white space and line terminators of ECMAScript, as a character class body
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim_ws(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def collapse_ws(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, rf"[{WS}]+", " ")


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(~c.rlike(rf"[^{WS}]"), F.lit(True))

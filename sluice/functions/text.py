"""Per-cell text cleaning as Column expressions (CLN-1..4, 6, 7, 9; MAP-2).

Every function keeps the work inside Spark's generated code: no Python UDFs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()),
# written as a Java/RE2 character class.  Spark's trim() only drops spaces.
PY_WHITESPACE_CLASS = (
    "[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)

# The same set as literal characters, for btrim (no regex on the hot path).
PY_WHITESPACE_CHARS = (
    "".join(chr(c) for c in range(0x09, 0x0E)) + "".join(chr(c) for c in range(0x1C, 0x21))
    + "\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c: Column) -> Column:
    """Remove leading and trailing whitespace the way Python's strip() does."""
    return F.btrim(c, F.lit(PY_WHITESPACE_CHARS))


def is_blank(c: Column) -> Column:
    """True when the cell is null or only whitespace."""
    return F.coalesce(py_strip(c) == F.lit(""), F.lit(True))


def blank_values(c: Column, values: Iterable[str]) -> Column:
    values = [v for v in values]
    if not values:
        return c
    return F.when(c.isin(values), F.lit("")).otherwise(c)


def remove_text(c: Column, text: str) -> Column:
    if not text:
        return c
    return F.replace(c, F.lit(text), F.lit(""))


def replace_text(c: Column, old: str, new: str) -> Column:
    if not old:
        return c
    return F.replace(c, F.lit(old), F.lit(new))


def replace_blank(c: Column, value: str) -> Column:
    if not value:
        return c
    return F.when(c == F.lit(""), F.lit(value)).otherwise(c)


def zero_for_blank(c: Column) -> Column:
    return F.when(c == F.lit(""), F.lit("0")).otherwise(c)


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def default_for_empty(c: Column, default: str) -> Column:
    """MAP-2: only an exactly empty cell takes the default (before trimming)."""
    return F.when(c == F.lit(""), F.lit(default)).otherwise(c)

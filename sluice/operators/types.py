"""TYP-1 inference and TYP-2 casting.

Inference is one aggregate over all columns: counts of non-empty, integer-like
and real-like cells.  Casting uses ``try_cast`` so "" in a numeric column
becomes null instead of failing an ANSI cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.order import visible_columns

# The number patterns of the contract (whole-cell match).  Digits
# are Unicode digits; ASCII text is checked with translate(), without a regex.
INT_PATTERN = "^(?U)[-+]?\\d+$"
REAL_PATTERN = "^(?U)[-+]?(\\d+(\\.\\d*)?|\\.\\d+)$"
LONG_DIGITS = 18


_DIGITS = "0123456789"


def _ascii_int(v):
    rest = F.translate(v, _DIGITS, "")
    return (F.length(v) > F.length(rest)) & (
        (rest == "") | (rest.isin("+", "-") & v.startswith(rest)))


def _ascii_real(v):
    rest = F.translate(v, _DIGITS, "")
    sign = F.substr(rest, F.lit(1), F.lit(1))
    return (F.length(v) > F.length(rest)) & (
        rest.isin("", ".") | (rest.isin("+", "-", "+.", "-.") & v.startswith(sign)))


def _non_ascii(v):
    return F.octet_length(v) != F.length(v)


def _is_int(v):
    """Whole-cell ``[-+]?\\d+`` with Unicode digits; regex only for non-ASCII text."""
    return _ascii_int(v) | (_non_ascii(v) & v.rlike(INT_PATTERN))


def _is_real(v):
    return _ascii_real(v) | (_non_ascii(v) & v.rlike(REAL_PATTERN))


# The text forms accepted as timestamps by date detection (DCL-8).
DATE_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def infer_types(df: DataFrame, mode: str = "auto", columns: list[str] | None = None) -> dict[str, T.DataType]:
    """TYP-1.  ``mode``: auto, text, or auto_dates (also detects timestamp columns)."""
    columns = columns or visible_columns(df)
    given = {f.name: f.dataType for f in df.schema.fields}
    fixed = {c: given[c] for c in columns if not isinstance(given[c], T.StringType)}
    if mode == "text":
        return {c: fixed.get(c, T.StringType()) for c in columns}
    columns_all = columns
    columns = [c for c in columns if c not in fixed]
    if not columns:
        return fixed
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        nonempty = v.isNotNull() & (v != "")
        is_int = nonempty & _is_int(v)
        aggs += [
            F.count_if(nonempty).alias(f"n{i}"),
            F.count_if(is_int).alias(f"i{i}"),
            F.count_if(nonempty & _is_real(v)).alias(f"r{i}"),
            F.max(F.when(is_int, F.length(v) - F.when(v.startswith("-") | v.startswith("+"), 1).otherwise(0))).alias(f"d{i}"),
        ]
        if mode == "auto_dates":
            parsed = F.coalesce(*[F.try_to_timestamp(v, F.lit(p)) for p in DATE_PATTERNS])
            aggs.append(F.count_if(nonempty & parsed.isNotNull()).alias(f"t{i}"))
    row = df.agg(*aggs).first()
    out: dict[str, T.DataType] = dict(fixed)
    for i, c in enumerate(columns):
        n, ints, reals, digits = row[f"n{i}"], row[f"i{i}"], row[f"r{i}"], row[f"d{i}"] or 0
        if n and ints == n:
            out[c] = T.LongType() if digits <= LONG_DIGITS else (T.DecimalType(38, 0) if digits <= 38 else T.StringType())
        elif n and reals == n:
            out[c] = T.DoubleType()
        elif mode == "auto_dates" and n and row[f"t{i}"] == n:
            out[c] = T.TimestampNTZType()
        else:
            out[c] = T.StringType()
    return {c: out[c] for c in columns_all}


def cast_columns(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    cols = []
    for c in df.columns:
        t = types.get(c)
        if t is None or isinstance(t, T.StringType):
            cols.append(F.col(f"`{c}`"))
        else:
            v = F.col(f"`{c}`")
            if isinstance(t, (T.LongType, T.DecimalType, T.DoubleType, T.IntegerType)):
                v = F.regexp_replace(v, "^\\+", "")
            if isinstance(t, T.TimestampNTZType):
                v = F.coalesce(*[F.try_to_timestamp(v, F.lit(p)) for p in DATE_PATTERNS]).cast("timestamp_ntz")
                cols.append(v.alias(c))
                continue
            cols.append(v.try_cast(t).alias(c))
    return df.select(*cols)

"""TYP-3: typed values to the text form of the contract (``cell_to_text``).

null -> "", timestamp -> ``YYYY-MM-DD HH:MM:SS``, date -> ISO date, boolean ->
``True``/``False``, floating point -> the shortest repr in Python's layout
(``10000000.0``, ``1e+16``, ``1e-05``), everything else -> its string cast.
All built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable, so
    the expression is not copied into every place that uses it (keeps the
    generated code small)."""
    return F.try_element_at(F.transform(F.array(value), fn), F.lit(1))


def _precise(c: Column) -> Column:
    """Python's repr of a double: shortest round-tripping digits (15-17), laid
    out fixed for -4 <= exp < 16, else ``d.ddde+XX``."""
    cands = F.array(*[F.format_string(f"%.{p - 1}e", c) for p in (15, 16, 17)])
    sci = F.coalesce(F.try_element_at(F.filter(cands, lambda x: x.cast("double") == c), F.lit(1)),
                     F.try_element_at(cands, F.lit(3)))
    pat = "^(-?)([0-9])\\.?([0-9]*)e([+-][0-9]+)$"

    def parts(s):
        digits = F.regexp_replace(F.concat(F.regexp_extract(s, pat, 2), F.regexp_extract(s, pat, 3)), "0+$", "")
        return F.struct(
            F.regexp_extract(s, pat, 1).alias("sign"),
            F.when(digits == "", F.lit("0")).otherwise(digits).alias("d"),
            F.regexp_extract(s, pat, 4).cast("int").alias("e"),
        )

    def layout(t):
        d, e = t["d"], t["e"]
        n = F.length(d)
        fixed = (
            F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
            .when(n <= e + 1, F.concat(F.rpad(d, e + 1, "0"), F.lit(".0")))
            .otherwise(F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)))
        )
        mant = F.when(n == 1, d).otherwise(F.concat(F.substr(d, F.lit(1), F.lit(1)), F.lit("."), F.substr(d, F.lit(2))))
        sci_py = F.concat(mant, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
        return F.concat(t["sign"], F.when((e >= -4) & (e < 16), fixed).otherwise(sci_py))

    return _bind(_bind(sci, parts), layout)


def double_to_text(c: Column) -> Column:
    java = c.cast("string")                      # Java digits and layout
    a = F.abs(c)
    # Between 1e-3 and 1e7 a short Java string (at most 15 digits) is already
    # Python's repr: one cast, no formatting (the common case).
    return (
        F.when(c.isNull(), F.lit(""))
        .when((a >= 1e-3) & (a < 1e7) & (F.length(java) <= 16), java)
        .when(F.isnan(c), F.lit("nan"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when(c == 0, F.when(java.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
        .otherwise(_precise(c))
    )


def to_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        v = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(dtype, T.DateType):
        v = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(dtype, T.BooleanType):
        v = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_to_text(c.cast("double"))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        v = F.to_json(c)
    else:
        v = c.cast("string")
    return F.coalesce(v, F.lit(""))


def as_text_frame(df, columns: list[str] | None = None):
    """Every visible column of a typed DataFrame as contract text."""
    columns = columns or [c for c in df.columns if not c.startswith("__")]
    types = {f.name: f.dataType for f in df.schema.fields}
    hidden = [c for c in df.columns if c.startswith("__")]
    return df.select(*[to_text(F.col(f"`{c}`"), types[c]).alias(c) for c in columns], *hidden)

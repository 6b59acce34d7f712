"""Date handling: strptime formats as Spark patterns (CLN-8) and the
three-format timestamp cascade of the run log (LOG-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directives and their Spark datetime pattern letters (one letter
# takes one digit or two, as strptime does).
STRPTIME_TO_SPARK = {
    "Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s",
    "y": "yy", "I": "h", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "f": "SSSSSS", "j": "D", "z": "Z", "%": "%",
}
# Digits of a one-letter field that touches another field.
FULL_WIDTH = {"m": 2, "d": 2, "H": 2, "M": 2, "S": 2, "I": 2, "j": 3}
# The output form of a parsed date cell.
DATE_TEXT_PATTERN = "yyyy-MM-dd HH:mm:ss"
# The run-log cascade, tried in this order.
CASCADE_PATTERNS = ["yyyy-M-d H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d"]


class UnsupportedFormat(ValueError):
    pass


def strptime_to_spark(fmt: str) -> str:
    """Translate a strptime format to a Spark datetime pattern; literal text is quoted."""
    out: list[str] = []
    literal: list[str] = []

    def flush() -> None:
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'")
            literal.clear()

    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            if i + 1 >= len(fmt):
                raise UnsupportedFormat(f"format ends with '%': {fmt!r}")
            d = fmt[i + 1]
            if d not in STRPTIME_TO_SPARK:
                raise UnsupportedFormat(f"strptime directive %{d} is not supported")
            if d == "%":
                literal.append("%")
            else:
                flush()
                field = STRPTIME_TO_SPARK[d]
                # without a character between them, neighbouring numbers need their full width
                joined = (i > 1 and fmt[i - 2] == "%" and fmt[i - 1] in "YymdHMSIj") or fmt[i + 2:i + 3] == "%"
                out.append(field * FULL_WIDTH[d] if joined and d in FULL_WIDTH else field)
            i += 2
            continue
        literal.append(ch)
        i += 1
    flush()
    return "".join(out)


def parse_date_text(c: Column, fmt: str, column_name: str) -> Column:
    """CLN-8: a non-empty cell must match ``fmt``; it becomes
    ``YYYY-MM-DD HH:MM:SS``.  A mismatch fails the job naming column, value
    and format, as the reference fails the import."""
    pattern = strptime_to_spark(fmt)
    parsed = F.try_to_timestamp(c, F.lit(pattern))
    message = F.concat(
        F.lit(f"date column {column_name}: value "), c, F.lit(f" does not match format {fmt}")
    )
    return (
        F.when(c.isNull() | (c == ""), c)
        .when(parsed.isNull(), F.raise_error(message).cast("string"))
        .otherwise(F.date_format(parsed, DATE_TEXT_PATTERN))
    )


def parse_cascade(c: Column) -> Column:
    """LOG-9: first of three formats that fits, else null (strict: whole text)."""
    trimmed = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(p)) for p in CASCADE_PATTERNS])

"""GEN-1..5: generated key, import time, source name, fixed value.

Key first (1..n over the surviving rows of each file), the others appended.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.clock import now_text
from sluice.functions.names import file_stem_col, transform_field_name
from sluice.operators.order import FILE, RN, renumber_survivors
from sluice.options import GenerateOptions, NamingOptions


class GenerateError(ValueError):
    pass


def _name(field: str, fallback: str, naming: NamingOptions) -> str:
    return transform_field_name(
        field, fallback,
        pinyin=naming.field_pinyin,
        replace_from=naming.field_replace_from,
        replace_to=naming.field_replace_to,
        case=naming.field_case,
    )


def file_name_col():
    """The file name of ``__file`` (a URI), decoded."""
    return F.url_decode(F.try_element_at(F.split(F.col(FILE), "/"), F.lit(-1)))


def generate(
    df: DataFrame,
    columns: list[str],
    o: GenerateOptions,
    naming: NamingOptions = NamingOptions(),
    *,
    deduped: bool = False,
    sheet: str = "",
    now: dt.datetime | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add the generated columns; returns the DataFrame and the final column list."""
    hidden = [c for c in df.columns if c.startswith("__")]
    final = list(columns)
    lead = []
    if o.key_field:
        if deduped:
            df = renumber_survivors(df)
        name = _name(o.key_field, "id", naming)
        lead.append(F.col(RN).cast("long").alias(name))
        final.insert(0, name)
    extras: list[tuple[str, object]] = []
    if o.import_time_field:
        extras.append((_name(o.import_time_field, "imported_at", naming), F.lit(now_text(now))))
    if o.source_name_field:
        src = F.lit(sheet) if sheet else file_stem_col(file_name_col())
        extras.append((_name(o.source_name_field, "sheet_name", naming), src))
    if o.fixed_value_field:
        extras.append((_name(o.fixed_value_field, "fixed_value", naming), F.lit(o.fixed_value)))
    final += [n for n, _ in extras]
    if len(set(final)) != len(final):
        raise GenerateError(f"generated column names collide: {final}")
    out = df.select(*lead, *[F.col(f"`{c}`") for c in columns], *[c.alias(n) for n, c in extras], *hidden)
    return out, final

"""MAP-1..4: mapping projection, defaults for empty cells, target names, match keys.

One ``select``; names are resolved on the driver from the column list only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.names import transform_field_name, unique_names
from sluice.functions.text import default_for_empty
from sluice.options import MappingItem, NamingOptions


class MappingError(ValueError):
    pass


def apply_mapping(
    df: DataFrame,
    columns: list[str],
    mapping: list[MappingItem] | None,
    naming: NamingOptions = NamingOptions(),
) -> tuple[DataFrame, list[str], list[str]]:
    """Returns (DataFrame with target columns + hidden columns, target names, match keys)."""
    if mapping is None:
        mapping = [MappingItem(i, c, True, "", i == 0) for i, c in enumerate(columns)]
    items = [m for m in mapping if 0 <= m.source_index < len(columns) and m.enabled]
    if not items:
        raise MappingError("at least one column must be enabled")
    raw_targets = [m.target or columns[m.source_index] for m in items]
    targets = unique_names(
        [
            transform_field_name(
                name, f"column_{i + 1}",
                pinyin=naming.field_pinyin,
                replace_from=naming.field_replace_from,
                replace_to=naming.field_replace_to,
                case=naming.field_case,
            )
            for i, name in enumerate(raw_targets)
        ]
    )
    cols = []
    for m, t in zip(items, targets):
        v = F.coalesce(F.col(f"`{columns[m.source_index]}`"), F.lit(""))
        if naming.default_for_empty or m.default_value:
            v = default_for_empty(v, m.default_value)
        cols.append(v.alias(t))
    keys = [t for m, t in zip(items, targets) if m.match_key] or targets[:1]
    hidden = [c for c in df.columns if c.startswith("__")]
    return df.select(*cols, *hidden), targets, keys

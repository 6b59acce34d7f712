"""Small builders for the DuckDB statements that check the registered queries."""

from __future__ import annotations

from sluice.functions.text import PY_WHITESPACE_CLASS


def strip(expr: str) -> str:
    """Python-strip of a text expression in DuckDB (RE2)."""
    cls = PY_WHITESPACE_CLASS
    return f"regexp_replace(coalesce({expr}, ''), '^{cls}+|{cls}+$', '', 'g')"


def stage_one(expr: str, blanks=(), remove: str = "", rfrom: str = "", rto: str = "", trim: bool = True) -> str:
    v = strip(expr) if trim else f"coalesce({expr}, '')"
    if blanks:
        lst = ", ".join("'" + b.replace("'", "''") + "'" for b in blanks)
        v = f"(CASE WHEN {v} IN ({lst}) THEN '' ELSE {v} END)"
    if remove:
        v = f"replace({v}, '{remove}', '')"
    if rfrom:
        v = f"replace({v}, '{rfrom}', '{rto}')"
    return v


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)

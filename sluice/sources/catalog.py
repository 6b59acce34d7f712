"""Table listing, detail, preview and search (SRC-16..19)."""

from __future__ import annotations

import json

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.load import q
from sluice.operators.sql import preview

# Preview sizes of the table views.
TABLE_PREVIEW_ROWS = 50
DETAIL_PREVIEW_ROWS = 100


def table_names(spark: SparkSession) -> list[tuple[str, str, str]]:
    """(name, type, comment) of tables and views, internal ``_`` names excluded, by name."""
    out = []
    for t in spark.catalog.listTables():
        if t.name.startswith("_"):
            continue
        out.append((t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "TABLE", t.description or ""))
    return sorted(out)


def source_listing(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """SRC-16: one row per table with its row count, as one union of counts."""
    entries = table_names(spark)
    if names is not None:
        wanted = set(names)
        entries = [e for e in entries if e[0] in wanted]
    if not entries:
        return spark.createDataFrame([], "name string, table_type string, comment string, row_count long")
    parts = [
        spark.table(q(n)).agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(n).alias("name"), F.lit(t).alias("table_type"), F.lit(c).alias("comment"), "row_count")
        for n, t, c in entries
    ]
    return reduce(DataFrame.unionByName, parts)


def search(listing: DataFrame, keyword: str) -> DataFrame:
    """SRC-19: case-insensitive match on name or comment."""
    k = (keyword or "").lower()
    if not k:
        return listing
    return listing.where(F.lower("name").contains(k) | F.lower(F.coalesce("comment", F.lit(""))).contains(k))


def _described(spark: SparkSession, table: str) -> dict:
    """What the catalog says of a table; nothing for temporary views."""
    try:
        return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {q(table)} AS JSON").first()[0])
    except Exception:  # noqa: BLE001 - temporary views are not in the catalog
        return {}


def table_detail(spark: SparkSession, table: str) -> dict:
    """SRC-17: the table's type and comment, its columns (with default and whether rows are dealt by them), DDL and a 100-row preview."""
    known = _described(spark, table)
    dealt = set(known.get("partition_columns") or []) | set(known.get("bucket_columns") or [])
    cols = [
        {"position": i + 1, "name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable,
         "default": f.metadata.get("CURRENT_DEFAULT", ""), "key": f.name in dealt, "comment": f.metadata.get("comment", "")}
        for i, f in enumerate(spark.table(q(table)).schema.fields)
    ]
    try:
        ddl = spark.sql(f"SHOW CREATE TABLE {q(table)}").first()[0]
    except Exception:  # noqa: BLE001 - temporary views have no DDL
        ddl = ""
    names, rows = preview(spark.table(q(table)), DETAIL_PREVIEW_ROWS)
    return {"name": table, "type": known.get("type", "VIEW"), "comment": known.get("comment", ""), "columns": cols, "ddl": ddl, "preview": {"columns": names, "rows": rows}}


def table_preview(spark: SparkSession, table: str) -> dict:
    """SRC-18: 50 rows as text plus the total."""
    df = spark.table(q(table))
    names, rows = preview(df, TABLE_PREVIEW_ROWS)
    return {"columns": names, "rows": rows, "total": df.count()}

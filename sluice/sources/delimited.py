"""SRC-1..4: delimited text scan into raw string cells ``c1..cN`` plus order columns.

Every file has its own charset (all bytes decide) and delimiter; files that agree
on both are read in one scan.  UTF-8 files without quoted line breaks go to
Spark's CSV reader, in splits.  Files with them, files of other charsets, and all
files where blank lines count as rows, are read as physical lines, in splits too:
lines are joined to records (``text_probe.records``) and a record is parsed by
``from_csv``.

The explicit all-string schema keeps every cell as text.  The width is found
by scanning with a generous schema and widening until the last column is
unused, so ragged rows lose no cells.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.order import BLOCK, FILE, POS, with_source_order
from sluice.operators.shape import used_width
from sluice.options import ReadOptions
from sluice.sources.files import SourceError, few_listing_tasks, java_charset, sniff_files
from sluice.sources.text_probe import is_wide, plain_records, probe, records

START_WIDTH = 32
MAX_WIDTH = 16384


def _schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(1, width + 1)])


def _options(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _widened(read, start: int) -> tuple[DataFrame, int]:
    """A frame as wide as its widest row, and the last column that holds a non-blank cell (SHP-1)."""
    width = start
    while True:
        df = read(width)
        # a look at the last column alone says whether rows may be wider; the cells of all columns are looked at once
        if width < MAX_WIDTH and not df.where(F.col(f"c{width}").isNotNull()).isEmpty():
            width = min(4 * width, max(MAX_WIDTH, width + 1))
            continue
        used = used_width(df)
        if used < width:
            return df, used
        if width >= MAX_WIDTH:  # wider rows would lose cells
            raise ValueError(f"rows have {width} columns or more; at most {MAX_WIDTH - 1} can be read")
        width = min(4 * width, max(MAX_WIDTH, width + 1))


def _csv_scan(spark: SparkSession, paths: list[str], delimiter: str, encoding: str, o: ReadOptions):
    def read(width: int) -> DataFrame:
        reader = spark.read.schema(_schema(width)).options(**_options(delimiter)).option("encoding", java_charset(encoding))
        if o.line_delimiter:
            reader = reader.option("lineSep", o.line_delimiter)
        return with_source_order(reader.csv(paths).select("*", "_metadata"))
    return read


def _record_scan(rows: DataFrame, delimiter: str):
    def read(width: int) -> DataFrame:
        cells = F.from_csv("record", ", ".join(f"{f.name} STRING" for f in _schema(width)), _options(delimiter))
        return rows.select(FILE, BLOCK, POS, cells.alias("r")).select("r.*", FILE, BLOCK, POS)
    return read


def _delimiters(spark: SparkSession, paths: list[str], o: ReadOptions) -> dict[str, str]:
    if o.delimiter:
        return dict.fromkeys(paths, o.delimiter)
    return sniff_files(spark, paths, o.encoding)


def read_delimited(spark: SparkSession, paths: list[str], o: ReadOptions = ReadOptions(), failed: dict[str, str] | None = None) -> DataFrame:
    """All cells of the files, with ``__file, __blk, __pos``; ``sluice_used_width`` is the number of used columns.
    Files that cannot be decoded raise, or are left out and named in ``failed``."""
    with few_listing_tasks(spark, paths):
        return _read_delimited(spark, paths, o, failed)


def _read_delimited(spark: SparkSession, paths: list[str], o: ReadOptions, failed: dict[str, str] | None) -> DataFrame:
    separator = o.line_delimiter or "\n"
    delimiters = _delimiters(spark, paths, o)
    facts = probe(spark, delimiters, o.encoding, separator, failed)
    groups: dict[tuple, list[str]] = defaultdict(list)
    for p in (p for p in paths if p in facts):
        groups[delimiters[p], facts[p].encoding, facts[p].quoted_breaks].append(p)
    found = []
    for (delimiter, encoding, breaks), some in groups.items():
        if breaks:
            read = _record_scan(records(spark, some, delimiter, encoding, separator), delimiter)
        elif not is_wide(encoding) and (o.blank_lines or java_charset(encoding) != "UTF-8"):
            read = _record_scan(plain_records(spark, some, encoding, separator), delimiter)
        else:
            read = _csv_scan(spark, some, delimiter, encoding, o)
        found.append(_widened(read, START_WIDTH))
    if not found:
        raise SourceError("; ".join((failed or {}).values()) or "no files to read")
    width = max(max(used for _, used in found), 1)

    def cells(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.coalesce(F.col(f"c{i}"), F.lit("")) if f"c{i}" in have else F.lit("")).alias(f"c{i}") for i in range(1, width + 1)], FILE, BLOCK, POS)

    out = reduce(DataFrame.union, [cells(df) for df, _ in found])
    out.sluice_used_width = max(used for _, used in found)
    return out

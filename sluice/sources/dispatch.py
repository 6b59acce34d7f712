"""SRC-12: suffix -> reader.  Each reader yields import units
``(raw DataFrame, header or None, sheet name)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from sluice.options import ReadOptions
from sluice.sources.files import SUPPORTED_SUFFIXES, SourceError, suffix_of


def read_units(spark: SparkSession, paths: list[str], o: ReadOptions, failed: dict[str, str] | None = None) -> Iterator[tuple[DataFrame, list[str] | None, str]]:
    suffixes = {suffix_of(p) for p in paths}
    if len(suffixes) != 1:
        raise SourceError("one scan takes files of one format")
    suffix = suffixes.pop()
    if suffix in {".csv", ".txt"}:
        from sluice.sources.delimited import read_delimited

        yield read_delimited(spark, paths, o, failed), None, ""
    elif suffix == ".json":
        from sluice.sources.json_source import read_json

        df, keys = read_json(spark, paths, o.row_tag)
        yield df, keys, ""
    elif suffix == ".xml":
        from sluice.sources.xml_source import read_xml

        df, keys = read_xml(spark, paths, o.row_tag)
        yield df, keys, ""
    elif suffix == ".dbf":
        from sluice.sources.dbf import read_dbf

        df, keys = read_dbf(spark, paths, o.encoding)
        yield df, keys, ""
    elif suffix in {".xlsx", ".xlsm"}:
        from sluice.sources.workbook import read_workbook_units

        yield from read_workbook_units(spark, paths, o)
    else:
        raise SourceError(f"unsupported file type {suffix or 'unknown'}; supported: {', '.join(SUPPORTED_SUFFIXES)}")

"""SRC-9: XML rows into text cells with Spark's built-in XML reader.

With a ``row_tag`` (at any depth) Spark's splittable XML reader is used; Spark
orders inferred fields by name, so the first-seen order comes from the data: a
scan of the text between closing row tags, in splits, keeps the least (file,
split, row, place) of every field path.  Without one, every child of the root is
a row whatever its tag, read in document order by a small Python data source (one
task per file).  Child text per field, one nested level as ``parent_child``,
attributes ignored, a repeated tag keeps its last value, missing -> "".
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluice.operators.order import BLOCK, FILE, POS, with_source_order
from sluice.sources.text_probe import raw_lines

#: Comments and character data (skipped), and tags with their attributes.
_MARKUP = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([^\s<>/!?]+)(?:"[^"]*"|'[^']*'|[^<>"'])*?(/?)>""", re.DOTALL)


def field_paths(text: str, row_tag: str) -> list[str]:
    """Fields of the row that begins in a text, in order; grandchildren with their parent's name in front."""
    found, stack, inside = [], [], False
    for m in _MARKUP.finditer(text):
        closing, name, empty = m.groups()
        if name is None:
            continue
        if not inside:
            inside = name == row_tag and not closing and not empty
            continue
        if closing:
            if stack:
                stack.pop()
            continue
        if len(stack) < 2:
            found.append("_".join([*stack, name]))
        if not empty:
            stack.append(name)
    return found


def first_seen(spark: SparkSession, paths: list[str], row_tag: str) -> dict[str, int]:
    """Rank of every field path by where it is seen first: file, split, row, place."""
    schema = f"{FILE} string, {BLOCK} long, {POS} long, place int, path string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = set(), []
        for batch in batches:
            for file, block, pos, raw in zip(*(c.to_pylist() for c in batch.columns)):
                for place, path in enumerate(field_paths(raw.decode("utf-8", "replace"), row_tag)):
                    if (file, path) not in known:  # a task reads a file's rows in order
                        known.add((file, path))
                        out.append((file, block, pos, place, path))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], [FILE, BLOCK, POS, "place", "path"])

    rows = raw_lines(spark, paths, f"</{row_tag}>").select(FILE, BLOCK, POS, F.col("line").cast("binary")).mapInArrow(run, schema)
    first = rows.groupBy("path").agg(F.min(F.struct(FILE, BLOCK, POS, "place")).alias("first")).orderBy("first").collect()
    return {r["path"]: i for i, r in enumerate(first)}


def _leaf(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        last = F.try_element_at(c, F.lit(-1))
        return _leaf(last, dtype.elementType)
    if isinstance(dtype, T.StructType):
        if "_VALUE" in dtype.names:
            return F.coalesce(c["_VALUE"].cast("string"), F.lit(""))
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(None)
        self.path = path


def _local_name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else str(tag)


class _ChildrenReader(DataSourceReader):
    """Rows = the root element's children, whatever their tag, in document order."""

    def __init__(self, options):
        self.paths = json.loads(options.get("paths", "[]"))

    def partitions(self):
        return [_FilePartition(p) for p in self.paths]

    def read(self, part):
        from xml.etree import ElementTree as ET

        from sluice.sources.files import open_read

        depth, idx = 0, 0
        root = None
        with open_read(part.path) as fh:
            for event, el in ET.iterparse(fh, events=("start", "end")):
                if event == "start":
                    depth += 1
                    if depth == 1:
                        root = el
                    continue
                depth -= 1
                if depth == 1:                       # a child of the root closed
                    names, values = [], []
                    for child in list(el):
                        if len(child):
                            for g in list(child):
                                names.append(f"{_local_name(child.tag)}_{_local_name(g.tag)}")
                                values.append(g.text or "")
                        else:
                            names.append(_local_name(child.tag))
                            values.append(child.text or "")
                    yield (part.path, idx, names, values)
                    idx += 1
                    el.clear()
                    if root is not None:
                        root.clear()


class XmlChildrenSource(DataSource):
    @classmethod
    def name(cls):
        return "sluice_xml_children"

    def schema(self):
        return "file string, idx long, __names array<string>, __values array<string>"

    def reader(self, schema):
        return _ChildrenReader(self.options)


def read_xml_children(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """No row tag: every child of the root is a row (one task per file; a
    single XML document is not splittable without a row tag)."""
    from sluice.session import ship_package
    from sluice.sources.json_source import cells_from_pairs

    ship_package(spark)
    spark.dataSource.register(XmlChildrenSource)
    rows = spark.read.format("sluice_xml_children").option("paths", json.dumps(list(paths))).load()
    rows = rows.select(F.col("file").alias(FILE), F.lit(0).cast("long").alias(BLOCK), F.col("idx").alias(POS),
                       "__names", "__values")
    out, keys = cells_from_pairs(rows, [FILE, POS], [FILE, BLOCK, POS])
    if not keys:
        raise ValueError("the XML rows hold no fields")
    return out, keys


def read_xml(spark: SparkSession, paths: list[str], row_tag: str = "") -> tuple[DataFrame, list[str]]:
    if not row_tag:
        return read_xml_children(spark, paths)
    tag, rank = row_tag, first_seen(spark, paths, row_tag)
    df = (
        spark.read.format("xml")
        .option("rowTag", tag)
        .option("excludeAttribute", "true")
        .option("inferSchema", "false")
        .option("ignoreSurroundingSpaces", "false")
        .load(paths)
    )
    cols: list[tuple[str, Column]] = []
    for f in df.schema.fields:
        if f.name == "_corrupt_record":
            continue
        ftype = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        base = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            base = F.try_element_at(base, F.lit(-1))
        if isinstance(ftype, T.StructType) and "_VALUE" not in ftype.names:
            cols += [(f"{f.name}_{child.name}", _leaf(base.getField(child.name), child.dataType)) for child in ftype.fields]
        else:
            cols.append((f.name, _leaf(base, ftype)))
    cols.sort(key=lambda c: rank.get(c[0], len(rank)))
    if not cols:
        raise ValueError("the XML rows hold no fields")
    names = [n for n, _ in cols]
    out = df.select(*[c.alias(f"c{i + 1}") for i, (_, c) in enumerate(cols)], "_metadata")
    return with_source_order(out), names

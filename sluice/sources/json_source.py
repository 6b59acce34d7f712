"""SRC-8 / SRC-10: JSON documents into rows of text cells.

Root handling: an array of objects; or a root object whose ``row_tag`` key,
else first list-valued key (document order), holds the rows; else the object
itself; JSON lines are read line by line.  Non-objects are dropped.  Objects
are flattened one level (``parent_child``), lists become JSON text, scalars
become contract text (``True``, ``3``, ``1.5``, ``1e+20``), null becomes "".
Columns are the union of keys in first-seen order.

Arrays and JSON lines are read in splits (``json_split``), a root object by one
task.  Flattening uses Python's json parser in Arrow batches; a malformed
document raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.order import BLOCK, FILE, POS
from sluice.session import ship_package
from sluice.sources.json_split import array_rows, layout, line_rows
from sluice.sources.text_probe import slices


def _text(value, in_child: bool) -> str:
    """The contract's text of a parsed value; lists are JSON at the first level and Python text inside a child."""
    if value is None:
        return ""
    return json.dumps(value, ensure_ascii=False) if isinstance(value, list) and not in_child else str(value)


def flat_fields(obj: dict) -> tuple[list[str], list[str]]:
    """Names and texts of an object's fields; fields of a child carry its name in front."""
    flat = [(path, _text(leaf, len(path) > 1)) for name, value in obj.items()
            for path, leaf in ([((name, inner), leaf) for inner, leaf in value.items()] if isinstance(value, dict) else [((name,), value)])]
    return ["_".join(path) for path, _ in flat], [text for _, text in flat]


def with_entries(df: DataFrame, obj_col: str) -> DataFrame:
    """Add ``__names`` / ``__values``: the flattened fields of each JSON object
    in ``obj_col``, in document order.

    Python's own parser gives the exact text forms (``True``, ``1e+20``, nested
    values as Python text) that no built-in expression reproduces; it runs
    Arrow-batched on the partitions Spark already has.
    """
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [
        T.StructField("__names", T.ArrayType(T.StringType())), T.StructField("__values", T.ArrayType(T.StringType())),
    ])
    pos = df.columns.index(obj_col)

    def run(batches):
        for pdf in batches:
            objects = [json.loads(text) if text is not None else None for text in pdf.iloc[:, pos]]
            fields = [flat_fields(o) if isinstance(o, dict) else ([], []) for o in objects]
            yield pdf.assign(__names=[f[0] for f in fields], __values=[f[1] for f in fields])

    return df.mapInPandas(run, schema)


def root_elements(text: str, row_tag: str = "") -> list[str]:
    """The row candidates of one document, each as JSON text.

    A document that does not parse as a whole is JSON lines if every non-blank
    line parses; otherwise the error is raised."""
    text = text.removeprefix("\ufeff").strip()
    if not text:
        return []
    try:
        root = json.loads(text)
    except ValueError:
        lines = [line for line in text.split("\n") if line.strip()]
        if len(lines) < 2:
            raise
        rows = [json.loads(line) for line in lines]
    else:
        rows = root if isinstance(root, list) else [root]
        if isinstance(root, dict):
            lists = [v for v in root.values() if isinstance(v, list)]
            if row_tag and row_tag in root:
                rows = root[row_tag]
            elif lists:
                rows = lists[0]
        elif not isinstance(root, list):
            raise ValueError("neither an object nor an array")
        if not isinstance(rows, list):
            raise ValueError(f"{row_tag} holds no array")
    return [json.dumps(row) for row in rows]


def with_elements(docs: DataFrame, row_tag: str = "") -> DataFrame:
    """``__elements`` in place of ``value``: the row candidates of each document.  A malformed document raises."""
    ship_package(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            elements = []
            for text, file in zip(pdf["value"], pdf[FILE]):
                try:
                    elements.append(root_elements(text, row_tag))
                except ValueError as exc:
                    raise ValueError(f"malformed JSON in {file}: {exc}") from exc
            yield pdf.drop(columns="value").assign(__elements=elements)

    return docs.mapInPandas(run, f"{FILE} string, {BLOCK} long, __elements array<string>")


def cells_from_pairs(withe: DataFrame, order_cols: list[str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows carrying ``__names``/``__values`` arrays -> text columns ``c1..cN``
    named by the union of names in first-seen order (only the distinct names
    reach the driver).  A later duplicate name in a row wins.  A batch's cells
    are put into their columns in one pass, whatever the number of names."""
    names = (
        withe.select(*order_cols, F.posexplode("__names").alias("__kp", "name"))
        .groupBy("name")
        .agg(F.min(F.struct(*[F.col(c) for c in order_cols], F.col("__kp"))).alias("__first"))
        .orderBy("__first")
        .collect()
    )
    keys = [r["name"] for r in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(keys)}
        for batch in slices(batches):
            at = batch.schema.names.index("__names")
            lists = batch.column(at)
            cells = np.full((len(keys), batch.num_rows), "", object)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            cells[[place[n] for n in lists.flatten().to_pylist()], row] = batch.column(at + 1).flatten().to_pylist()
            kept = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cells], *kept], [*[f"c{i + 1}" for i in range(len(keys))], *keep])

    schema = T.StructType([T.StructField(f"c{i + 1}", T.StringType()) for i in range(len(keys))] + [withe.schema[c] for c in keep])
    return withe.select(*keep, "__names", "__values").mapInArrow(run, schema), keys


def flatten_rows(df: DataFrame, json_col: str, order_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Objects in ``json_col`` -> text columns named by the key union.

    ``order_cols`` give first-seen order of keys (e.g. file, position).  Only
    the distinct key names (with their first position) reach the driver.
    """
    withe = with_entries(df.where(F.ltrim(F.col(json_col)).startswith("{")), json_col)
    return cells_from_pairs(withe, order_cols, [c for c in df.columns if c != json_col])


def document_rows(spark: SparkSession, paths: list[str], row_tag: str) -> DataFrame:
    """``__file, __blk, __pos, __names, __values`` of documents that are read whole."""
    docs = spark.read.text(paths, wholetext=True).select(
        F.col("value"), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)
    )
    elems = with_elements(docs, row_tag).select(FILE, BLOCK, F.posexplode("__elements").alias(POS, "__obj"))
    elems = elems.where(F.ltrim("__obj").startswith("{")).withColumn(POS, F.monotonically_increasing_id())
    return with_entries(elems, "__obj").select(FILE, BLOCK, POS, "__names", "__values")


def read_json(spark: SparkSession, paths: list[str], row_tag: str = "") -> tuple[DataFrame, list[str]]:
    ship_package(spark)
    parts, kinds = layout(spark, paths)
    groups: dict[str, list[str]] = {}
    for uri, kind in kinds.items():
        groups.setdefault(kind, []).append(unescaped(uri))
    read = {"array": lambda some: array_rows(spark, some, parts.where(F.col(FILE).isin([u for u, k in kinds.items() if k == "array"])), flat_fields),
            "lines": lambda some: line_rows(spark, some, flat_fields), "document": lambda some: document_rows(spark, some, row_tag)}
    found = [read[kind](some) for kind, some in groups.items()]
    if not found:
        raise ValueError("the JSON holds no object rows to import")
    out, keys = cells_from_pairs(reduce(DataFrame.union, found), [FILE, BLOCK, POS], [FILE, BLOCK, POS])
    if not keys:
        raise ValueError("the JSON holds no object rows to import")
    return out, keys


def unescaped(uri: str) -> str:
    """The path that a file's URI stands for."""
    from urllib.parse import unquote

    return unquote(uri)

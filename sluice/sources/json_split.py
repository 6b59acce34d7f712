"""Large JSON files in splits: where the elements of a root array are.

A file is read as the text between its closing braces, which any split can do.
A piece is a function of the state before it (inside a string or not): it says
the state after it and by how much the nesting depth changes.  Functions compose,
so a split is one function; a prefix scan over the splits of a file gives every
split the state and depth it starts with, and a file that does not end at depth 0
outside a string is malformed.

An element that is an object ends at a brace that leads back to depth 1.  Between
two such braces lies one chunk: the elements that are no objects, then the object.
Chunks inside a split are parsed there; what crosses a split is put together from
the pieces (two texts a split) and parsed then.  Every byte of a file is parsed
in exactly one chunk, so nothing malformed passes.

Files of JSON lines are recognised by a first object that is closed before the
end of the file's first split and followed by more; their lines are parsed one by
one.  A root that is an object is one document, read by one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators.order import BLOCK, FILE, POS, bounded_side
from sluice.sources.text_probe import is_broadcast, raw_lines, slices, states_before

_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|["\[\]{]', re.DOTALL)
_CLOSE = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.DOTALL)

_SPLIT = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("out_depth", pa.int64()), ("in_depth", pa.int64()),
                    ("bytes", pa.int64()), ("size", pa.int64()), ("first", pa.string()), ("closed", pa.bool_()), ("more", pa.bool_())])
_SPLIT_SQL = f"{FILE} string, {BLOCK} long, outside boolean, inside boolean, out_depth long, in_depth long, bytes long, size long, first string, closed boolean, more boolean"
_FOUND = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), (POS, pa.int64()), ("kind", pa.string()), ("text", pa.string()),
                    ("__names", pa.list_(pa.string())), ("__values", pa.list_(pa.string()))])
_FOUND_SQL = f"{FILE} string, {BLOCK} long, {POS} long, kind string, text string, __names array<string>, __values array<string>"


def walk(piece: bytes, inside: bool) -> tuple[bool, int]:
    """State after the text before a closing brace, and how much deeper it leads (the brace not counted)."""
    at, deeper = 0, 0
    if inside:
        end = _CLOSE.match(piece)
        if not end:
            return True, 0
        at = end.end()
    for token in _TOKEN.finditer(piece, at):
        sign = token[0]
        if sign == b'"':
            return True, deeper
        if len(sign) == 1:
            deeper += -1 if sign == b"]" else 1
    return False, deeper


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(whether a new split begins, then the row) for rows whose first two columns are file and split."""
    place = None
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[:2] != place, row
            place = row[:2]


def splits(pieces: DataFrame) -> DataFrame:
    """One row per split: its function, its bytes and its file's, its first character and, for the first split of a file, whether the
    first root is closed in it and something follows (there or in later splits: a split's ``first``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for fresh, (file, block, piece, size) in _by_split(batches):
            if fresh:
                if now:
                    yield pa.RecordBatch.from_pylist([now], _SPLIT)
                now = {FILE: file, BLOCK: block, "outside": False, "inside": True, "out_depth": 0, "in_depth": 0, "bytes": 0, "size": size, "first": None, "closed": False, "more": False}
            now["bytes"] += len(piece) + 1
            filled = piece.strip()
            now["more"] = now["more"] or (now["closed"] and bool(filled))
            if now["first"] is None and filled:
                now["first"] = filled[:1].decode("latin-1")
            for state, depth in (("outside", "out_depth"), ("inside", "in_depth")):
                now[state], deeper = walk(piece, now[state])
                now[depth] += deeper - (not now[state])
            now["closed"] = now["closed"] or (not now["outside"] and now["out_depth"] == 0)
        if now:
            yield pa.RecordBatch.from_pylist([now], _SPLIT)

    return pieces.select(FILE, BLOCK, F.col("line").cast("binary"), "size").mapInArrow(run, _SPLIT_SQL)


def layout(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The splits of all files, and every file's kind: array, lines or document."""
    pieces = raw_lines(spark, paths, "}")
    parts = splits(pieces).checkpoint()
    first = F.min_by("first", F.when(F.col("first").isNotNull(), F.col(BLOCK))).alias("first")
    start = F.col(BLOCK) == 0
    rows = parts.groupBy(FILE).agg(first, F.bool_or(start & F.col("closed")).alias("closed"), F.bool_or((start & F.col("more")) | (~start & F.col("first").isNotNull())).alias("more")).collect()
    kind = lambda r: "array" if r["first"] == "[" else "lines" if r["first"] == "{" and r["closed"] and r["more"] else "document"
    return parts, {r[FILE]: kind(r) for r in rows}


def array_rows(spark: SparkSession, paths: list[str], parts: DataFrame, flatten: Callable[[dict], tuple[list[str], list[str]]]) -> DataFrame:
    """``__file, __blk, __pos, __names, __values`` of the objects in root arrays."""
    states = states_before(parts.select(FILE, BLOCK, "outside", "inside"))
    met = parts.join(states, [FILE, BLOCK])
    chosen = lambda a, b: F.when(F.col("before"), F.col(b)).otherwise(F.col(a))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(chosen("out_depth", "in_depth")).over(earlier), F.lit(0))
    started = met.select(FILE, BLOCK, "before", depth.alias("depth"), chosen("out_depth", "in_depth").alias("deeper"), chosen("outside", "inside").alias("after"), "bytes", "size").checkpoint()
    # a last piece without a brace was counted as if it had one; a byte order mark is not among the bytes
    ends = started.groupBy(FILE).agg(F.sum("deeper").alias("depth"), F.max_by("after", BLOCK).alias("inside"), (F.sum("bytes") - F.max("size")).alias("over"))
    broken = ends.where(F.col("inside") | (F.col("depth") != -1) | ~F.col("over").isin(1, -2)).select(FILE).head(1)
    if broken:
        raise ValueError(f"malformed JSON in {broken[0][0]}: the file does not end where its array does")

    before, _ = bounded_side(started.select(FILE, BLOCK, "before", "depth"))
    pieces = raw_lines(spark, paths, "}").join(before, [FILE, BLOCK])
    if not is_broadcast(before):
        pieces = pieces.repartition(FILE, BLOCK).sortWithinPartitions(FILE, BLOCK, POS)

    def parsed(file: str, text: str) -> list:
        try:
            return json.loads(text)
        except ValueError as exc:
            raise ValueError(f"malformed JSON in {file}: {exc}") from exc

    def text_of(file: str, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError as exc:
            raise ValueError(f"malformed JSON in {file}: {exc}") from exc

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, met_one, inside, depth, number, place = [], [], False, False, 0, 0, None

        def rest() -> None:
            if place and (held or met_one):  # an empty tail opens a text as well
                out.append((*place, 0, "tail" if met_one else "through", text_of(place[0], b"".join(held)), None, None))

        for fresh, (file, block, piece, before, deep) in _by_split(batches):
            if fresh:
                rest()
                held, met_one, inside, depth, number, place = [], False, before, deep, 0, (file, block)
            held += [piece, b"}"]
            inside, deeper = walk(piece, inside)
            depth += deeper - (not inside)
            if not inside and depth == 1:
                text = text_of(file, b"".join(held))
                if met_one:
                    out.append((file, block, number, "row", None, *flatten(parsed(file, f"[0{text}]")[-1])))
                    number += 1
                else:
                    out.append((file, block, 0, "head", text, None, None))
                held, met_one = [], True
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r)) for r in out], _FOUND)
                out = []
        rest()
        yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r)) for r in out], _FOUND)

    found = pieces.select(FILE, BLOCK, F.col("line").cast("binary"), "before", "depth").mapInArrow(cut, _FOUND_SQL).checkpoint()  # parsed once, whatever looks at the rows later
    rows = found.where("kind = 'row'").select(FILE, (F.col(BLOCK) * 2 + 1).alias(BLOCK), POS, "__names", "__values")

    # texts that cross splits: a tail opens one, the next split's head ends it
    texts = found.where("kind <> 'row'").withColumn("opens", (F.col("kind") == "tail").cast("int"))
    running = Window.partitionBy(FILE).orderBy(BLOCK, "opens").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("number", F.sum("opens").over(running))
    parts_of = F.array_sort(F.collect_list(F.struct(BLOCK, "opens", "text")))
    joined = texts.groupBy(FILE, "number").agg(F.array_join(F.transform(parts_of, lambda p: p["text"]), "").alias("text"), F.max(BLOCK).alias(BLOCK), F.bool_or(F.col("kind") == "head").alias("ended"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for file, number, text, block, ended in zip(*(c.to_pylist() for c in batch.columns)):
                opening = "[0" if number else ""
                if ended:
                    out.append((file, block, 0, "row", None, *flatten(parsed(file, opening + text.removeprefix("﻿") + "]")[-1])))
                else:  # to the end of the file, where no brace stands
                    parsed(file, opening + text.removeprefix("﻿").removesuffix("}"))
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r)) for r in out], _FOUND)

    crossing = joined.select(FILE, "number", "text", BLOCK, "ended").mapInArrow(stitch, _FOUND_SQL)
    return rows.union(crossing.select(FILE, (F.col(BLOCK) * 2).alias(BLOCK), POS, "__names", "__values"))


def line_rows(spark: SparkSession, paths: list[str], flatten: Callable[[dict], tuple[list[str], list[str]]]) -> DataFrame:
    """The same for files of JSON lines; lines that hold no object are left out, malformed ones raise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for file, block, pos, line in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = json.loads(line.decode()) if line.strip() else None
                except ValueError as exc:
                    raise ValueError(f"malformed JSON in {file}: {exc}") from exc
                if isinstance(value, dict):
                    out.append((file, block, pos, "row", None, *flatten(value)))
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r)) for r in out], _FOUND)

    lines = raw_lines(spark, paths).select(FILE, BLOCK, POS, F.col("line").cast("binary"))
    return lines.mapInArrow(run, _FOUND_SQL).select(FILE, BLOCK, POS, "__names", "__values")

"""Facts about text files that only all their bytes can tell: charset and quoted line feeds.

One scan over the physical lines of all files, in their splits.  No character of
the supported charsets contains a line feed byte, so lines can be judged one by
one: a file's charset is the first candidate that decodes every line.  The JVM
settles lines that are valid UTF-8 without quotes; only the others reach Python.

Whether a line ends inside a quoted cell depends on the state before it.  A line
is a function of that state (outside or inside), functions compose, and so a
split is one function as well.  ``records`` runs such a prefix scan over the
splits of a file and then joins physical lines to records, in their splits; only
records that cross a split are put together from pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators.order import BLOCK, FILE, POS, bounded_side
from sluice.sources.files import AUTO_ENCODINGS, SourceError, java_charset

QUOTE = '"'
#: Charsets of which a line feed byte may be part of another character: their lines cannot be judged alone.
_WIDE = ("utf-16", "utf16", "utf-32", "utf32", "ucs")
#: Whole paths that are written the same as URIs.
_PLAIN_URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:(//[A-Za-z0-9.:-]+)?(/[A-Za-z0-9_=~-][A-Za-z0-9._=~-]*)+")


@dataclass(frozen=True)
class TextFacts:
    encoding: str          # Python's name
    quoted_breaks: bool    # a quoted cell goes on after the end of a line


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``; ``inside``: one was open before it."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if QUOTE not in line[at:]:
                return False
            if line[at] != QUOTE:
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += len(delimiter)
                if at >= n:
                    return False
                continue
            at += 1
        # in a quoted cell: to its closing quote, doubled ones are content
        inside = False
        while True:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line[at + 1:at + 2] != QUOTE:
                break
            at += 2
        at = line.find(delimiter, at + 1)
        if at < 0 or at + len(delimiter) >= n:
            return False
        at += len(delimiter)


def is_wide(encoding: str) -> bool:
    return encoding.lower().startswith(_WIDE)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in small parts: Python objects are made of few rows at a time, however long their texts are."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def raw_lines(spark: SparkSession, paths: list[str], separator: str = "\n") -> DataFrame:
    """``__file, __blk, __pos, line`` (undecoded bytes as they stand in a string) and ``size`` (of the file) of all physical lines."""
    return spark.read.option("lineSep", separator).text(paths).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POS), F.col("value").alias("line"), F.col("_metadata.file_size").alias("size"))


def probe(spark: SparkSession, delimiters: dict[str, str], encoding: str = "auto", separator: str = "\n",
          failed: dict[str, str] | None = None) -> dict[str, TextFacts]:
    """Facts of every file; ``delimiters`` names the files.  A file that no candidate decodes raises, or is left out with
    its message in ``failed``."""
    if is_wide(encoding or "auto"):
        return {p: TextFacts(encoding, False) for p in delimiters}
    # only files that are no UTF-8 are read for the others
    tries = [["utf-8"], [e for e in AUTO_ENCODINGS if not e.startswith("utf")]] if (encoding or "auto") == "auto" else [[encoding]]
    found: dict[str, TextFacts] = {}
    for candidates in tries:
        groups: dict[str, list[str]] = {}
        for path, delimiter in delimiters.items():
            if path not in found:
                groups.setdefault(delimiter, []).append(path)
        for delimiter, paths in groups.items():
            found |= _facts(spark, paths, delimiter, candidates, separator)
    for lost in (p for p in delimiters if p not in found):
        message = f"{lost}: could not recognize the text encoding (tried {', '.join(sum(tries, []))})"
        if failed is None:
            raise SourceError(message)
        failed[lost] = message
    return found


def _facts(spark: SparkSession, paths: list[str], delimiter: str, candidates: list[str], separator: str) -> dict[str, TextFacts]:
    """Facts of the files that a candidate decodes."""
    def rows(by: str, quotes: bool) -> dict:
        return {re.sub(r"^([A-Za-z][\w+.-]*):///", r"\1:/", r[FILE]): r for r in _judged(raw_lines(spark, paths, by), delimiter, candidates, quotes).collect()}

    judged = rows("\n", separator == "\n")
    breaks = judged if separator == "\n" else rows(separator, True)
    found = {}
    for path in paths:
        uri = _uri(spark, path)
        good = [i for i in range(len(candidates)) if uri not in judged or not judged[uri]["bad"][i]]
        if good:
            found[path] = TextFacts(candidates[good[0]], uri in breaks and breaks[uri]["breaks"][good[0]])
    return found


def _uri(spark: SparkSession, path: str) -> str:
    """A path as ``_metadata.file_path`` writes it (no empty authority)."""
    if _PLAIN_URI.fullmatch(path):  # most paths are: no call to the JVM for each of many files
        return path
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(fs_path).toUri().toString()
    return re.sub(r"^([A-Za-z][\w+.-]*):///", r"\1:/", uri)


def _judged(lines: DataFrame, delimiter: str, candidates: list[str], quotes: bool) -> DataFrame:
    """Per file with a line that needs judging: ``bad`` and ``breaks``, one flag for each candidate.

    Breaks are searched as if every split began outside a quoted cell: the first split with such a line does."""
    k = len(candidates)
    plain = F.expr("is_valid_utf8(line)")
    if candidates != ["utf-8"]:  # ASCII alone is the same in all
        plain = plain & (F.octet_length("line") == F.length("line"))
    suspect = lines.where(~plain | F.contains("line", F.lit(QUOTE))) if quotes else lines.where(~plain)
    schema = pa.schema([(FILE, pa.string()), ("bad", pa.list_(pa.bool_())), ("breaks", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bad, breaks, inside = None, [False] * k, [False] * k, [False] * k
        for batch in slices(batches):
            for file, block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, block) != place:
                    if place is not None:
                        yield pa.RecordBatch.from_pylist([{FILE: place[0], "bad": bad, "breaks": breaks}], schema)
                    place, bad, breaks, inside = (file, block), [False] * k, [False] * k, [False] * k
                for i, name in enumerate(candidates):
                    if bad[i]:
                        continue
                    try:
                        text = line.decode(name)
                    except UnicodeDecodeError:
                        bad[i] = True
                        continue
                    if quotes and QUOTE in text:
                        inside[i] = ends_inside(text, delimiter, inside[i])
                        breaks[i] = breaks[i] or inside[i]
        if place is not None:
            yield pa.RecordBatch.from_pylist([{FILE: place[0], "bad": bad, "breaks": breaks}], schema)

    flags = suspect.select(FILE, BLOCK, F.col("line").cast("binary").alias("line")).mapInArrow(run, f"{FILE} string, bad array<boolean>, breaks array<boolean>")
    any_of = lambda c: F.array(*[F.bool_or(F.col(c)[i]) for i in range(k)]).alias(c)
    return flags.groupBy(FILE).agg(any_of("bad"), any_of("breaks"))


def plain_records(spark: SparkSession, paths: list[str], encoding: str, separator: str) -> DataFrame:
    """``__file, __blk, __pos, record`` of files in which every line is a record.

    UTF-8 is what Spark's strings are; lines of other charsets are decoded in Arrow batches, by the codec that judged them."""
    lines = raw_lines(spark, paths, separator)
    if java_charset(encoding) != "UTF-8":
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = pa.array([line.decode(encoding) for line in batch.column(3).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], batch.schema.names)

        lines = lines.select(FILE, BLOCK, POS, F.col("line").cast("binary")).mapInArrow(run, f"{FILE} string, {BLOCK} long, {POS} long, line string")
    return lines.select(FILE, BLOCK, POS, _without_return(F.col("line"), separator).alias("record"))


def _without_return(record: Column, separator: str) -> Column:
    """Records that end with a line feed may have a carriage return before it."""
    return F.regexp_replace(record, r"\r\z", "") if separator == "\n" else record


def split_functions(lines: DataFrame, delimiter: str, encoding: str) -> DataFrame:
    """``__file, __blk, outside, inside``: the state after a split, by the state before it (true: in a quoted cell)."""
    schema = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = None, [False, True]
        for batch in slices(batches):
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, block) != place:
                    if place is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*place, *state)))], schema)
                    place, state = (file, block), [False, True]
                if b'"' in line:
                    text = line.decode(encoding)
                    state = [ends_inside(text, delimiter, s) for s in state]
        if place is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*place, *state)))], schema)

    return lines.select(FILE, BLOCK, F.col("line").cast("binary")).mapInArrow(run, f"{FILE} string, {BLOCK} long, outside boolean, inside boolean")


def states_before(functions: DataFrame) -> DataFrame:
    """``__file, __blk, before``: the state before each split, by composing the functions of all splits before it.

    A function is constant, the identity or the swap: the state is the last constant's, swapped as often as there are swaps after it."""
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)
    counted = functions.withColumn("swaps", F.coalesce(F.sum(swap).over(earlier), F.lit(0)))
    constant = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("value"), "swaps"))
    last = counted.withColumn("last", F.last(constant, ignorenulls=True).over(earlier))
    odd = (F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    return last.select(FILE, BLOCK, (F.coalesce(F.col("last.value"), F.lit(False)) != odd).alias("before"))


def records(spark: SparkSession, paths: list[str], delimiter: str, encoding: str, separator: str) -> DataFrame:
    """``__file, __blk, __pos, record`` of files with quoted line breaks.

    Records keep the split in which they begin.  Those that end in a later one get a split number of their own, right
    behind it (numbers are doubled), so positions stay dense within a split."""
    lines = raw_lines(spark, paths, separator)
    before, _ = bounded_side(states_before(split_functions(lines, delimiter, encoding)))
    met = lines.join(before, [FILE, BLOCK])
    if not is_broadcast(before):  # the shuffle has mixed the lines
        met = met.repartition(FILE, BLOCK).sortWithinPartitions(FILE, BLOCK, POS)
    schema = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), (POS, pa.int64()), ("head", pa.bool_()), ("open", pa.bool_()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, head, state, number = None, [], False, False, 0
        for batch in slices(batches):
            out: list[tuple] = []
            for file, block, line, inside in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, block) != place:
                    if held:
                        out.append((*place, number, head, True, separator.join(held)))
                    place, held, head, state, number = (file, block), [], inside, inside, 0
                text = line.decode(encoding)
                state = ends_inside(text, delimiter, state) if QUOTE in text else state
                held.append(text)
                if not state:
                    out.append((*place, number, head, False, separator.join(held)))
                    held, number, head = [], number + (not head), False
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*place, number, head, True, separator.join(held))))], schema)

    found = met.select(FILE, BLOCK, F.col("line").cast("binary").alias("line"), "before")
    found = found.mapInArrow(run, f"{FILE} string, {BLOCK} long, {POS} long, head boolean, open boolean, record string")
    found = found.checkpoint()  # lines are joined once, in their splits, whatever looks at the records later
    whole = found.where(~F.col("head") & ~F.col("open")).select(FILE, (F.col(BLOCK) * 2).alias(BLOCK), POS, "record")
    # pieces: an open record, then what the next splits begin with, up to one that is closed
    pieces = found.where("head OR open").withColumn("first", (~F.col("head")).cast("int"))
    order = [F.col(BLOCK), F.col("first")]
    grouped = pieces.withColumn("number", F.sum("first").over(Window.partitionBy(FILE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(BLOCK, "first", "record")))
    joined = grouped.groupBy(FILE, "number").agg(parts.alias("parts"), F.min(BLOCK).alias(BLOCK))
    crossing = joined.select(FILE, (F.col(BLOCK) * 2 + 1).alias(BLOCK), F.lit(0).cast("long").alias(POS), F.array_join(F.transform("parts", lambda p: p["record"]), separator).alias("record"))
    return whole.union(crossing).withColumn("record", _without_return(F.col("record"), separator))


def is_broadcast(df: DataFrame) -> bool:
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

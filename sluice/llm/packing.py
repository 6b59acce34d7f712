"""Packing: first-fit decreasing with a tournament tree, in random groups.

Documents are encoded, closed with an end id and cut into pieces of at most
``length`` ids.  Documents are dealt into random groups of a bounded expected
size; each group is packed on its own by first-fit decreasing, where a
tournament tree over bin capacities finds the leftmost bin that still has
room in logarithmic time.  Only piece spans are shuffled, never ids; the group
of a row depends on its place as well as its id, so one repeated id does not
fill a group.

Null text counts as empty: such a document is its end id alone.  Long texts are
encoded whole and cut into pieces.  Repeated
rows are packed each for itself.  Ties in length go by document id, row and
start.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.encoding import encoder
from sluice.llm.words import blocks

#: Documents a group holds on average.  Groups are only of this size so that one fits a task; larger ones waste less.
GROUP_DOCS = 4096
#: Bytes of text encoded at once (a longer text is taken alone).
ENCODE_BYTES = 2 << 20

_PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("grp", pa.int64()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECES_SQL = "doc_id long, row long, grp long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bins:
    """First fit over equal bins.  ``tree`` is a tournament: each inner node
    holds the largest room left among the bins below it."""

    def __init__(self, capacity: int, most: int):
        self.capacity = capacity
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Place ``size`` into the leftmost bin with room; (bin, offset there)."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        offset = self.capacity - tree[node]
        tree[node] -= size
        at, node = node - self.leaves, node >> 1
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
        return at, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size; ``sizes`` must not increase."""
    bins = Bins(capacity, len(sizes))
    placed = [bins.put(s) for s in sizes]
    return [p[0] for p in placed], [p[1] for p in placed]


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int, groups: int, seed: int,
                  id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents, with the group each document belongs to."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "text", "row", F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(groups)).alias("grp"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in (part for b in batches for part in blocks(b, 1, ENCODE_BYTES)):
            ids, counts = encode.closed(batch.column(1), end_id)
            ids, ends = ids.astype("<u4"), np.cumsum(counts)
            pieces = -(-counts // length)  # of each document
            row = np.repeat(np.arange(len(counts)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(counts[row] - start, length)
            first = (ends - counts)[row] + start
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(first.tolist(), (first + size).tolist())]
            take = pa.array(row)
            doc, place, grp = (batch.column(i).take(take) for i in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([doc, place, grp, *[pa.array(c, pa.int64()) for c in (start, size, crc, counts[row])]], schema=_PIECES)

    return rows.mapInArrow(cut, _PIECES_SQL)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, group_docs: int = GROUP_DOCS, seed: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start`` (ids of its document before it),
    ``length, ids_crc32, doc_tokens, sequence_id, offset``.  Offsets are gapless
    within a sequence; sequence ids are unique, not consecutive."""
    groups = max(1, -(-docs.count() // group_docs))
    pieces = cut_documents(docs, tokenizer, end_id, length, groups, seed, id_col, text_col)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        at, offset = first_fit_decreasing(table["length"].to_pylist(), length)
        base = table["grp"][0].as_py() << 32
        table = table.drop_columns(["row", "grp"])
        return table.append_column("sequence_id", pa.array([base + b for b in at], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pieces.groupBy("grp").applyInArrow(place, _PLACED_SQL)

"""Benchmark decontamination: training documents against test n-grams.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond
ASCII.  Every run of ``n`` words of a test item is a window (an item of fewer
words is one window of its own).  The windows' hashes are a set that every task
holds; each document is scanned once in its partition, without a shuffle: words
become numbers of the test vocabulary, runs of known words are hashed at every
position, and a hash that is in the set counts only after its words have been
compared one by one.  All words inside an occurrence are hit.

The set is broadcast in blocks of at most ``BLOCK`` bytes of test words; every
further block is one more scan of the documents, whose result adds to the one
before.  Long items are split into overlapping segments first, so no block
exceeds its size.

``find`` adds the hits to the documents, ``remove_documents`` and ``remove_spans``
use them.  Null, empty and wordless texts have no words and no hits; long texts
are scanned whole.  Rows repeat as they come.  Test items of null or empty text
have no windows; rows of one item id are one item (a null id is the item ``''``).
An empty test table hits nothing, an empty document table gives no rows.  Columns
``__n_words``, ``__runs`` and ``__items`` of the input are replaced (the removals leave
them out); all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sluice.llm.shared import cut
from sluice.llm.words import Cutter, blocks

#: Words of a window.
WINDOW = 10
#: Bytes of test words in one broadcast, and words of a segment of a test item.
BLOCK, SEGMENT = 16 << 20, 4096
#: Scans that are planned as one stage.
SCANS = 4

#: ASCII that is no part of a word (fixed by the contract): all but digits and letters.
NO_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
_CUTTER = Cutter(NO_WORD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STATE = [StructField("__n_words", LongType()), StructField("__runs", ArrayType(IntegerType())), StructField("__items", ArrayType(StringType()))]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         n: int = WINDOW, keep_text: bool = True, block_bytes: int = BLOCK) -> DataFrame:
    """``docs`` with ``__n_words``, ``__runs`` (first and last word of each run of hit words) and
    ``__items`` (ids of the items with a window in the text, as strings, ascending)."""
    spark = docs.sparkSession
    docs = docs.drop(*[f.name for f in _STATE])
    parts = cut(_segments(benchmark, item_id, item_text, n), "test-words")
    total = parts.agg(F.sum(F.octet_length("words") + F.octet_length("item")).alias("b")).first()["b"] or 0
    count = max(1, -(-total * 5 // (4 * block_bytes)))
    found = docs.select("*", F.lit(None).cast("long").alias("__n_words"), F.array().cast("array<int>").alias("__runs"), F.array().cast("array<string>").alias("__items"))
    for b in range(count):
        rows = parts.filter(F.pmod(F.xxhash64("item", "at"), F.lit(count)) == b).select("item", "words").toArrow()
        windows = spark.sparkContext.broadcast(Windows.of(rows, n))
        found = _scanned(found, windows, text, keep_text or b + 1 < count)
        if b % SCANS == SCANS - 1 and b + 1 < count:
            found = cut(found, "test-hits")
    return found


def n_hit() -> Column:
    """Hit words of a row of ``find``."""
    lengths = F.expr("transform(__runs, (x, i) -> if(i % 2 = 0, 1L - x, cast(x AS long)))")
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)


def remove_documents(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without those of which some words, and at least this share, are hit."""
    found = find(docs, benchmark, **options)
    dirty = (n_hit() > 0) & (n_hit() >= F.col("__n_words") * least_share)
    return found.filter(~dirty).drop(*[f.name for f in _STATE])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` whose texts have lost each run of hit words, from the first one's start to the last one's end."""
    found = find(docs, benchmark, text=text, **options)
    names = found.columns
    at, runs_at = names.index(text), names.index("__runs")
    own = {f.name for f in _STATE}
    kept = [c for c in range(len(names)) if names[c] not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            runs = batch.column(runs_at).to_pylist()
            for i in (i for i, r in enumerate(runs) if r):
                cutting = _CUTTER.cut(pa.array([texts[i]], pa.string()))
                raw, keep, last = texts[i].encode(), [], 0
                for a, z in zip(runs[i][::2], runs[i][1::2]):
                    keep.append(raw[last:cutting.start[a]])
                    last = int(cutting.end[z])
                texts[i] = b"".join([*keep, raw[last:]]).decode()
            columns = [pa.array(texts, batch.column(at).type) if c == at else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, [names[c] for c in kept])

    return found.mapInArrow(run, StructType([found.schema[names[c]] for c in kept]))


def _segments(benchmark: DataFrame, item_id: str, item_text: str, n: int) -> DataFrame:
    """``item, at, words``: words of a test item, space-joined, in segments that overlap by ``n - 1`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found = _CUTTER.cut(part.column(1))
                ends = np.cumsum(found.per_row())
                out: list[tuple[str, int, str]] = []
                for i, item in enumerate(part.column(0).to_pylist()):
                    words = found.words[ends[i - 1] if i else 0:ends[i]]
                    for a in range(0, max(1, len(words) - n + 1), SEGMENT):
                        if len(words):
                            out.append((item, a, " ".join(words[a:a + SEGMENT + n - 1].to_pylist())))
                yield pa.RecordBatch.from_pylist([dict(zip(("item", "at", "words"), r)) for r in out],
                                                 pa.schema([("item", pa.string()), ("at", pa.int64()), ("words", pa.string())]))

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("words"))
    return rows.mapInArrow(run, "item string, at long, words string")


@dataclass
class Windows:
    """Windows of one block of test words, by length."""

    vocabulary: pa.Array
    items: pa.Array
    #: Per window length: sorted hashes, word numbers of each window, and the items of each (offsets, item numbers).
    kinds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: pa.Table, n: int) -> "Windows":
        found = _CUTTER.cut(_whole(rows["words"]))
        coded = found.words.dictionary_encode()
        codes, sizes = coded.indices.to_numpy().astype(np.int32), found.per_row()
        items = _whole(rows["item"]).dictionary_encode()
        owner = items.indices.to_numpy()[found.row]
        lengths = np.minimum(sizes, n)[found.row]
        left = np.cumsum(sizes)[found.row] - np.arange(len(codes))
        kinds = {}
        for k in np.unique(lengths).tolist():
            at = np.flatnonzero((lengths == k) & (left >= k))
            grid = codes[at[:, None] + np.arange(k)]
            both = np.unique(np.column_stack([grid, owner[at]]), axis=0)
            grid, place = np.unique(both[:, :k], axis=0, return_inverse=True)
            hashes = _hashes(grid)
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rank = rank[place.ravel()]
            by = np.argsort(rank, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(order)))])
            kinds[k] = hashes[order], grid[order], offsets, both[by, k]
        return Windows(coded.dictionary, items.dictionary, kinds)

    def hits(self, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and pairs of text row and item number (distinct)."""
        hit = np.zeros(len(found.words) + 1, np.int64)
        pairs = [np.zeros(0, np.int64)]
        if len(found.words) and self.kinds:
            codes = pc.fill_null(pc.index_in(found.words, value_set=self.vocabulary), -1).to_numpy()
            # words up to the next one that is unknown or of another text
            stops = np.flatnonzero((codes < 0) | np.concatenate([found.row[1:] != found.row[:-1], [True]]))
            nearest = stops[np.searchsorted(stops, np.arange(len(codes)))]
            room = nearest - np.arange(len(codes)) + (codes[nearest] >= 0)
            for k, (hashes, grid, offsets, owner) in self.kinds.items():
                at = np.flatnonzero(room >= k)
                for a in range(0, len(at), 1 << 18):
                    some = at[a:a + (1 << 18)]
                    taken = codes[some[:, None] + np.arange(k)]
                    mine = _hashes(taken)
                    place, last = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, side="right")
                    while len(some):
                        near = place < last
                        some, taken, place, last = some[near], taken[near], place[near], last[near]
                        same = (grid[place] == taken).all(axis=1)
                        np.add.at(hit, some[same], 1)
                        np.add.at(hit, some[same] + k, -1)
                        which = place[same]
                        many = offsets[which + 1] - offsets[which]
                        rows = np.repeat(found.row[some[same]], many)
                        spots = np.repeat(offsets[which] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(which) else which, many) + np.arange(many.sum())
                        pairs.append(np.unique(rows * np.int64(len(self.items)) + owner[spots]))
                        place = place + 1
        pairs = np.unique(np.concatenate(pairs))
        return np.cumsum(hit[:-1]) > 0, pairs // max(1, len(self.items)), pairs % max(1, len(self.items))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.string()) for c in column.chunks] or [pa.array([], pa.string())])


def _hashes(grid: np.ndarray) -> np.ndarray:
    """One hash per row of word numbers."""
    out = np.full(len(grid), np.uint64(grid.shape[1]))
    for column in grid.T:
        out = (out ^ column.astype(np.uint64)) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _scanned(docs: DataFrame, windows, text: str, keep_text: bool) -> DataFrame:
    """One scan of the documents against one block of windows; adds to the hits that they have."""
    names = docs.columns
    at, runs_at, items_at = names.index(text), names.index("__runs"), names.index("__items")
    left = [c for c in range(len(names)) if (keep_text or c != at) and names[c] not in {f.name for f in _STATE}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            for part in blocks(batch, at):
                found = _CUTTER.cut(part.column(at))
                hit, rows, items = known.hits(found)
                sizes = found.per_row()
                firsts = np.cumsum(sizes) - sizes
                runs, names_of = part.column(runs_at).to_pylist(), part.column(items_at).to_pylist()
                for i in np.unique(found.row[hit]).tolist():
                    mine = hit[firsts[i]:firsts[i] + sizes[i]].copy()
                    for a, z in zip(runs[i][::2], runs[i][1::2]):
                        mine[a:z + 1] = True
                    edge = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
                    runs[i] = np.column_stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1]).ravel().tolist()
                names_found = known.items.take(pa.array(items)).to_pylist()
                for i, name in zip(rows.tolist(), names_found):
                    names_of[i].append(name)
                for i in np.unique(rows).tolist():
                    names_of[i] = sorted(set(names_of[i]), key=str.encode)
                state = [pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(names_of, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in left] + state, [names[c] for c in left] + [f.name for f in _STATE])

    return docs.mapInArrow(run, StructType([docs.schema[names[c]] for c in left] + _STATE))

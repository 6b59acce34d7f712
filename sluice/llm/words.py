"""Words of many texts at once, cut on bytes.

A rule says what each ASCII byte is (part of a word, a separator, or a break that
also ends a piece); bytes of other characters are always part of a word.  All
words of an Arrow array of texts become one Arrow array, without a Python object
per word, and A-Z is lower-cased in the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut into words at once (a longer text is taken alone).
BLOCK_BYTES = 16 << 20

_SEPARATOR, _WORD, _BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass
class Words:
    words: pa.StringArray
    #: Row of each word's text.
    row: np.ndarray
    #: Bytes where each word starts and ends, counted from the start of the first text.
    start: np.ndarray
    end: np.ndarray
    #: Bytes where each text starts, and the end of the last one.
    offsets: np.ndarray
    #: Whether a word and the one before it lie in the same piece of the same text.
    joined: np.ndarray

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.offsets) - 1)


class Cutter:
    """``separators`` and ``breaks`` are ASCII bytes; all others belong to words."""

    def __init__(self, separators: bytes, breaks: bytes = b""):
        self.kind = np.full(256, _WORD, np.uint8)
        self.kind[list(separators)] = _SEPARATOR
        self.kind[list(breaks)] = _BREAK

    def cut(self, texts: pa.Array) -> Words:
        offsets, raw = text_bytes(texts)
        kind = self.kind[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        word = np.zeros(len(raw) + 2, bool)
        np.equal(kind, _WORD, out=word[1:-1])
        before, after = word[:-1], word[1:]
        start = np.flatnonzero(after & (first | ~before))
        end = np.flatnonzero(before & (first | ~after))
        letters = _LOWER[raw[word[1:-1]]]
        places = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=places[1:])
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(letters))
        row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.searchsorted(start, offsets)))
        breaks = np.searchsorted(np.flatnonzero(kind == _BREAK), start)
        joined = np.zeros(len(start), bool)
        joined[1:] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        return Words(words, row, start, end, offsets, joined)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of an array of texts; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def blocks(batch: pa.RecordBatch, column: int, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about equal bytes of text, each of at most ``limit`` or one row."""
    limit = limit or BLOCK_BYTES
    offsets, _ = text_bytes(batch.column(column))
    parts = max(1, -(-int(offsets[-1]) // limit))
    share = max(1, -(-int(offsets[-1]) // parts))
    at, n = 0, batch.num_rows
    while at < n:
        z = int(np.searchsorted(offsets, offsets[at] + share, side="right")) - 1
        z = n if offsets[-1] - offsets[at] <= share else min(n, max(at + 1, z))
        yield batch.slice(at, z - at)
        at = z


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct integers in order of appearance, the place of each input among them, and their counts."""
    coded = pa.array(codes).dictionary_encode()
    places = coded.indices.to_numpy()
    return coded.dictionary.to_numpy(), places, np.bincount(places, minlength=len(coded.dictionary))

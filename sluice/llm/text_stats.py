"""Statistics of whole texts, appended to a table of documents.

Words are maximal runs of anything but space and the control characters 9 to
13.  All counts are exact and cover the whole text; null text counts as empty.
Statistic columns carry the prefix ``__s_``, so they clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

PREFIX = "__s_"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper",
         "n_digits", "n_punct", "n_exclaim", "n_bars", "n_wide", "longest"]
#: Words of a window that counts as repeated.
WINDOW = 8


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_SEPARATORS, _SYMBOLS = _bytes(" \t\n\x0b\x0c\r"), _bytes("#*$%&|<>")
_PUNCT = _bytes("!\"'(),-./:;?@[\\]^_`{}~+=")


def repeated_words(codes: np.ndarray) -> int:
    """Words inside windows that occur twice or more; exact, by naming windows
    of 2, 4 and 8 words one after another."""
    if len(codes) <= WINDOW:
        return 0
    names = codes
    for gap in (1, 2, 4):
        _, names = np.unique(names[:-gap] * (len(codes) + 1) + names[gap:], return_inverse=True)
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str | None) -> list[int]:
    """The statistics of one text, in the order of ``NAMES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0] * len(NAMES)
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(count[0x80:0xC0].sum())
    return [
        len(words), points - int(count[_SEPARATORS].sum()), int(count[_SYMBOLS].sum()), len(lines) - len(set(lines)),
        repeated_words(codes) if len(seen) < len(words) else 0, len(lines), len(seen), int(count[65:91].sum()), int(count[48:58].sum()),
        int(count[_PUNCT].sum()), int(count[33]), int(count[124]), int(count[0xC0:].sum()), max(map(len, seen)),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one long column per statistic."""
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *[StructField(PREFIX + n, LongType()) for n in NAMES]])
    names = schema.names

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([measure(t.as_py()) for t in batch.column(at)], np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in stats.T]], names)

    return docs.mapInArrow(add, schema)

"""MAP-5: pinyin initials of CJK text.

No pinyin dictionary is available, so the table is built from a rule: the
first level of GB2312 (3,755 common characters, codes B0A1-D7F9) is ordered by
pinyin, so the initial of a character is given by the first code of each
letter.  Characters outside that level (rare characters) are kept as they are,
and polyphones get the reading that decides their GB2312 position.

The same table drives the driver-side function (for names) and a Column
expression built on ``translate`` (for data), which stays inside generated code.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# First GB2312 code of each initial letter (i, u, v start no syllable).
INITIAL_BOUNDARIES = [
    ("a", 0xB0A1), ("b", 0xB0C5), ("c", 0xB2C1), ("d", 0xB4EE), ("e", 0xB6EA),
    ("f", 0xB7A2), ("g", 0xB8C1), ("h", 0xB9FE), ("j", 0xBBF7), ("k", 0xBFA6),
    ("l", 0xC0AC), ("m", 0xC2E8), ("n", 0xC4C3), ("o", 0xC5B6), ("p", 0xC5BE),
    ("q", 0xC6DA), ("r", 0xC8BB), ("s", 0xC8F6), ("t", 0xCBFA), ("w", 0xCDDA),
    ("x", 0xCEF4), ("y", 0xD1B9), ("z", 0xD4D1),
]
LEVEL1_LAST = 0xD7F9


@lru_cache(maxsize=1)
def _table() -> dict[str, str]:
    codes = [c for _, c in INITIAL_BOUNDARIES]
    table: dict[str, str] = {}
    for hi in range(0xB0, 0xD8):
        for lo in range(0xA1, 0xFF):
            code = (hi << 8) | lo
            if code > LEVEL1_LAST:
                break
            try:
                ch = bytes([hi, lo]).decode("gb2312")
            except UnicodeDecodeError:
                continue
            table[ch] = INITIAL_BOUNDARIES[bisect.bisect_right(codes, code) - 1][0]
    return table


def pinyin_initials(value: str) -> str:
    table = _table()
    return "".join(table.get(ch, ch) for ch in value or "")


@lru_cache(maxsize=1)
def _translate_strings() -> tuple[str, str]:
    table = _table()
    return "".join(table.keys()), "".join(table.values())


def pinyin_initials_col(c: Column) -> Column:
    src, dst = _translate_strings()
    return F.translate(c, src, dst)

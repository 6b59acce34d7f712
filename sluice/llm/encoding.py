"""Whole-text encoding with the ``tokenizers`` library, with a word cache.

A byte-level or a word-end BPE never lets a token cross the start of a space
run, so a text may be cut there and equal chunks need encoding once.  All texts
of a batch are cut on their bytes at once, distinct chunks are looked up or
encoded, and the ids of all chunks are gathered in one step; ids are the
library's own.  A chunk of plain letters goes straight to the library's BPE
model, any other one through the whole tokenizer.  Texts that hold the literal
of an added token (``<|endoftext|>``), in any case, and all texts of tokenizers
whose pre-tokenizer is not one of these two are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from sluice.llm.words import text_bytes

#: Fixed value: the word pattern of byte-level BPE (letters, digits, signs, each with the space before; white space).
BYTE_LEVEL_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries kept per worker before the cache starts afresh, and the longest chunk that is kept.
CACHE_ENTRIES = 400_000
ONCE_ENTRIES = 600_000
CACHE_CHUNK = 64

#: Chunks of which every Unicode version has the same classes, cases and composition.
_PLAIN = re.compile(r"[\n -~\u00a1-\u024f]*")
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder of a tokenizer file; loaded once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """``batch(texts)`` -> the ids of all texts, and their number by text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        self.literals = [t["content"] for t in spec.get("added_tokens") or []]
        self.chunks, words, self.lower = _rules(spec)
        self.words = words and regex.compile(words).findall
        self.model = self.tokenizer.model.tokenize
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.cache: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian bytes of ``dtype``."""
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        whole = self._whole(texts)
        if not whole.any():
            return self._chunked(texts)
        ids, counts = [], []
        edges = np.flatnonzero(np.diff(whole, prepend=~whole[:1], append=~whole[-1:]))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if whole[a]:
                some = [self._encoded(t) for t in texts[a:z].to_pylist()]
                ids += some
                counts.append(np.array([len(x) for x in some], np.int64))
            else:
                run, n = self._chunked(texts[a:z])
                ids.append(run)
                counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with ``end_id`` after each text."""
        ids, counts = self.batch(texts)
        ends = np.cumsum(counts + 1) - 1
        out = np.empty(len(ids) + len(counts), self.dtype)
        out[ends] = end_id
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = ids
        return out, counts + 1

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Texts that must be encoded whole."""
        if self.chunks is None:
            return np.ones(len(texts), bool)
        found = [pc.match_substring(texts, literal, ignore_case=True).to_numpy(zero_copy_only=False) for literal in self.literals]
        return np.any(found, axis=0) if found else np.zeros(len(texts), bool)

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, per_text = self.chunks(*text_bytes(texts))
        if not len(chunks):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        coded = chunks.dictionary_encode()
        known, fresh = self.cache.get, self._fresh
        raws = [known(c) or fresh(c) for c in coded.dictionary.to_pylist()]
        sizes = np.array([len(r) for r in raws], np.int64) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(raws), self.dtype)
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])])

    def _fresh(self, chunk: str) -> bytes:
        raw = self.once.get(chunk)
        if raw is not None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[chunk] = raw
            return raw
        if self.words and _PLAIN.fullmatch(chunk):
            words = self.words(chunk.lower() if self.lower else chunk)
            raw = self._word(words[0]) if len(words) == 1 else b"".join([self.cache.get(w) or self.once.get(w) or self._word(w) for w in words])
        else:
            raw = self._encoded(chunk).tobytes()
        if len(chunk) <= CACHE_CHUNK:
            self._keep(chunk, raw)
        return raw

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pre-tokenizer, from the library's BPE model."""
        if word.isascii() and " " not in word and "\n" not in word:
            visible = word
        elif word.isascii() and word[0] == " " and word[1:].isalnum():
            visible = _SPACE + word[1:]
        else:
            visible = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        raw = array(self.code, [t.id for t in self.model(visible)]).tobytes()
        if len(word) <= CACHE_CHUNK:
            self._keep(word, raw)
        return raw

    def _keep(self, chunk: str, raw: bytes) -> None:
        """What comes a second time moves on to the cache proper, so that
        words seen once never push out the common ones."""
        if len(self.once) >= ONCE_ENTRIES:
            self.once.clear()
        self.once[chunk] = raw


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE writes a byte as a visible character: its own where that
    is visible, else the next free one from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()
_SPACE = chr(_BYTE_CHARS[32])


def _rules(spec: dict):
    """How to cut texts (None: not at all), the pattern of words in a plain chunk (None: unknown), and whether they are lower-cased."""
    pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    plain_model = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normalizer:
        return _keep_spaces, plain_model and BYTE_LEVEL_WORDS, False
    steps = [n.get("type") for n in (normalizer or {}).get("normalizers", [])]
    match pre.get("pretokenizers"):
        case [{"type": "Split", "behavior": "Removed", "invert": True, "pattern": {"Regex": words}}, {"type": "ByteLevel", "use_regex": False}] \
                if steps == ["NFC", "Replace", "Lowercase"] and r"[^\s\p{L}\p{N}]+" in words:
            return _drop_spaces, plain_model and words, True
    return None, None, False


def _strings(places: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _drop_spaces(offsets: np.ndarray, raw: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Space and line feed only separate words here; they make no ids.  The chunks, and their number by text."""
    kept = (raw != 32) & (raw != 10)
    edge = np.zeros(len(raw), bool)
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    start = np.flatnonzero(kept & (edge | ~np.concatenate([[False], kept[:-1]])))
    places = np.concatenate([[0], np.cumsum(kept)])
    return _strings(np.append(places[start], places[-1]), raw[kept]), np.diff(np.searchsorted(start, offsets))


def _keep_spaces(offsets: np.ndarray, raw: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Chunks that start at the first space of a run after a visible character.  A single line feed between two visible
    characters is a token of its own.  Characters that are white space, or may be, are no place to cut at."""
    ends, begins = (raw > 32) & (raw != 127), (raw > 32) & (raw != 127)
    for lead in _WIDE_SPACE:
        for at in np.flatnonzero(raw == lead).tolist() if lead != 0xE2 else np.flatnonzero((raw[:-2] == lead) & (raw[1:-1] >> 1 == 0x40)).tolist():
            if raw[at:at + 3 - (lead == 0xC2)].tobytes() in _WIDE_SPACE[lead]:
                begins[at] = ends[min(len(raw) - 1, at + 2 - (lead == 0xC2))] = False
    start = np.zeros(len(raw) + 1, bool)
    start[offsets] = True
    edge = start.copy()
    after = np.concatenate([[False], ends[:-1]]) & ~edge[:-1]
    before = np.concatenate([begins[1:], [False]]) & ~edge[1:]
    start[:-1] |= (raw == 32) & after
    feed = np.flatnonzero((raw == 10) & after & before)
    start[feed] = start[feed + 1] = True
    places = np.flatnonzero(start[:-1])
    return _strings(np.append(places, len(raw)), raw), np.diff(np.searchsorted(places, offsets))


#: Characters beyond ASCII that are white space, by the first byte of their UTF-8 form.
_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE_SPACE = {lead: {c.encode() for c in _SPACES if c.encode()[0] == lead} for lead in (0xC2, 0xE1, 0xE2, 0xE3)}

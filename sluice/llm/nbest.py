"""SentencePiece encoding and decoding: n-best segmentation.

The best ``n`` segmentations of a text into the pieces of a model, by the sum
of piece scores.  Forward Viterbi scores over the piece lattice say exactly
how well a prefix can still do, so they guide a backward A-star search: it
starts at the end, and the first ``n`` paths that reach the start are the best
ones, in order.

No piece spans the place where a word begins or a line breaks, so the lattice
of a text is a chain of word lattices.  Words get their Viterbi pass and the
lead of their best segmentation once, all new words of many texts in one pass
over arrays (kept for the next texts); best segmentations are put together by
array too, and the search itself runs only over words whose lead is small
enough to matter.

Scores are fixed-point integers, so sums are exact.  Ties go to the smaller
piece id at the last place where two segmentations differ.  A character that
no piece covers becomes its byte pieces, scored below every piece.  Null and
empty texts have one empty segmentation.  Texts with fewer segmentations than
``n`` give all they have.  Repeated rows are encoded each.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sluice.llm.words import blocks

#: Units of a score, what an uncovered character costs beyond the lowest score, and words kept per worker.
UNIT, PENALTY, KEPT = 1 << 20, 10, 400_000
SPACE = "▁"
#: Words end before a space or a line feed; where no piece spans them, also between a letter and a stop or comma.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_PARTS = re.compile(f"{SPACE}*\\w+(?=[.,{SPACE}\n]|$)|{SPACE}*[^{SPACE}\n]+?(?=(?<=\\w)[.,]|{SPACE}|\n|$)|{SPACE}+|\n")
#: Stands for no score, and for the lead of an only segmentation.
_NONE, _ALONE = -(1 << 60), 1 << 62
#: Longest word that is kept and of a pass over many words, bytes of text encoded at once, and characters whose steps are a table.
LONGEST, TEXT_BYTES, COMMON = 32, 4 << 20, 128
#: Words of one pass are padded to the next of these lengths, and most words of a pass.
_WIDTHS, PASS = np.array([8, 12, 16, 24, LONGEST]), 1 << 15
_MODELS: dict[str, "Model"] = {}


class Segmentation(NamedTuple):
    score: int
    ids: tuple[int, ...]


def crc_of(raws: list[bytes]) -> int:
    """crc32 of the text that bytes of words decode to."""
    return zlib.crc32(text_of(b"".join(raws)).encode("utf-8", "surrogatepass"))


def replace(open_ends: list[tuple], at: int, more: list[tuple], most: int) -> None:
    """Put the continuations of an end in its place and keep the best ``most`` ends.

    Ends stand in the order of their pieces from the end of the text, so the first of equal cost comes
    first; as every end can be completed at its cost, no end beyond the best ``most`` is ever needed."""
    open_ends[at:at + 1] = more
    if len(open_ends) > most:
        best = sorted(range(len(open_ends)), key=lambda i: (open_ends[i][0], i))[:most]
        open_ends[:] = [open_ends[i] for i in sorted(best)]


def model(path: str) -> "Model":
    """The worker's model of a file; loaded once per process."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        everyone = range(sp.get_piece_size())
        plain = [i for i in everyone if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): (round(sp.get_score(i) * UNIT), i) for i in plain}
        self.set_up(pieces, {int(sp.id_to_piece(i)[3:5], 16): i for i in everyone if sp.is_byte(i)}, sp.unk_id())

    def set_up(self, pieces: dict[str, tuple[int, int]], byte_ids: dict[int, int], unknown: int = 0) -> None:
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        #: every beginning of a piece; None where it is no piece itself
        self.begins = {p[:k]: pieces.get(p[:k]) for p in pieces for k in range(1, len(p) + 1)}
        self.longest = max(map(len, pieces), default=1)
        self.lowest = min((s for s, _ in pieces.values()), default=0) - PENALTY * UNIT
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p) for p in pieces)
        self.surface = {i: p.replace(SPACE, " ").encode() for p, (_, i) in pieces.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.split = (_WORDS if any(re.search(r"\w[.,]", p) for p in pieces) else _PARTS).findall
        #: row of every known word; of each row its best score, its lead, whether its pieces decode to it, whether it came
        #: again, and where its ids end
        self.row: dict[str, int] = {}
        self.score, self.lead, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.own, self.again, self.ends = np.zeros(0, bool), np.zeros(0, bool), np.zeros(1, np.int64)
        self.passing: list[str] = []
        self.searched: dict[tuple[str, int], list[tuple]] = {}
        self.keys: np.ndarray | None = None

    def tabulate(self) -> None:
        """The beginnings of pieces as arrays: the state after a state and a character (0: no piece begins so), by sorted
        keys, and for common characters by a table.  States that go on come first, so do common characters."""
        inner = {p[:-1] for p in self.begins}
        order = sorted(self.begins, key=lambda p: p not in inner)
        state = {"": 1} | {p: i for i, p in enumerate(order, 2)}
        often = Counter(p[-1] for p in self.begins)
        kind = {c: i for i, c in enumerate(sorted(often, key=lambda c: (-often[c], c)))}
        self.kinds = len(kind)  # stands for all other characters
        self.kind_of = np.full(max(map(ord, kind), default=0) + 2, self.kinds)
        self.kind_of[[ord(c) for c in kind]] = list(kind.values())
        self.alone = np.array([c in self.pieces for c in kind] + [False])
        self.going = len(inner - {""}) + 2
        keys = np.array([state[p[:-1]] * (self.kinds + 1) + kind[p[-1]] for p in order], np.int64)
        by_key = np.argsort(keys)
        self.keys, self.nexts = keys[by_key], by_key + 2
        found = [(0, -1)] * 2 + [self.begins[p] or (0, -1) for p in order]
        self.state_score, self.state_id = (np.array(x, np.int64) for x in zip(*found))
        self.common = min(self.kinds, COMMON)
        steps = np.zeros((self.going, self.common + 1), np.int32)  # the last one is for all other characters
        at, of = np.divmod(self.keys, self.kinds + 1)
        steps[at[of < self.common], of[of < self.common]] = self.nexts[of < self.common]
        self.steps = steps.ravel()

    def after(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        key = state * (self.kinds + 1) + kind
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nexts[at], 0)

    def after_common(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return self.steps[state * (self.common + 1) + kind]

    def learn(self, words: Iterable[str]) -> None:
        """Rows for all words.  New ones of about one length get one forward pass; longer ones, and those with characters that no
        piece covers, get one each."""
        if self.keys is None:
            self.tabulate()
        self.forget()
        words, get = set(words), self.row.get
        new = [w for w in words if w not in self.row] if self.row else list(words)
        if len(new) < len(words):
            self.again[[r for w in words if (r := get(w)) is not None]] = True
        names, parts, each = [], [], []
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        width = np.searchsorted(_WIDTHS, lengths) if len(self.keys) else np.full(len(new), len(_WIDTHS))
        of_width = [(longest, np.flatnonzero(width == i)) for i, longest in enumerate(_WIDTHS.tolist())]
        for longest, here in [(longest, x[k:k + PASS]) for longest, x in of_width for k in range(0, len(x), PASS)]:
            some, sizes = [new[j] for j in here.tolist()], lengths[here]
            points = np.array(some, f"<U{longest}").view(np.uint32).reshape(len(some), longest)
            kinds = self.kind_of[np.minimum(points, len(self.kind_of) - 1)]
            outside = np.arange(longest) >= sizes[:, None]
            kinds[outside] = self.kinds
            covered = (self.alone[kinds] | outside).all(axis=1)
            common = covered & ((kinds < self.common) | outside).all(axis=1)
            for mine, after, other in ((common, self.after_common, self.common), (covered & ~common, self.after, self.kinds)):
                if mine.any():
                    names += [some[j] for j in np.flatnonzero(mine).tolist()]
                    parts.append(self.forward_many(np.ascontiguousarray(np.minimum(kinds[mine], other).T), sizes[mine], after, other))
            each += [some[j] for j in np.flatnonzero(~covered).tolist()]
        self.passing = [new[j] for j in np.flatnonzero(width == len(_WIDTHS)).tolist()]
        known = [self.alone_word(w) for w in each + self.passing]
        if known:
            score, ids, lead, _, raw = zip(*known)
            own = [r == plain(w) for w, r in zip(each + self.passing, raw)]
            parts.append((np.array(score), np.array([_ALONE if x is None else x for x in lead]), np.array(own),
                          np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], "<u4")))
        if parts:
            self.row.update(zip(names + each + self.passing, range(len(self.row), len(self.row) + len(new))))
            score, lead, own, sizes, ids = map(np.concatenate, zip(*parts))
            self.score, self.lead, self.own = (np.concatenate(x) for x in ((self.score, score), (self.lead, lead), (self.own, own)))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids, self.again = np.concatenate([self.ids, ids]), np.concatenate([self.again, np.zeros(len(new), bool)])

    def forget(self) -> None:
        """Leave long words, and of too many words those that came once."""
        if self.passing:
            for w in self.passing:
                del self.row[w]
            self.keep(np.arange(len(self.row)))
            self.passing = []
        if len(self.row) > KEPT:
            rows = np.flatnonzero(self.again)
            rows = rows[:0] if len(rows) > KEPT // 2 else rows
            names = list(self.row)
            self.row = {names[r]: i for i, r in enumerate(rows.tolist())}
            self.keep(rows)
            self.again[:] = False

    def keep(self, rows: np.ndarray) -> None:
        ids, places = self.ids_of(rows)
        self.score, self.lead, self.own, self.again = self.score[rows], self.lead[rows], self.own[rows], self.again[rows]
        self.ids, self.ends = ids, places

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentations of words by row, one after another, and where each word begins and the last one ends."""
        starts = self.ends[rows]
        sizes = self.ends[rows + 1] - starts
        places = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes, out=places[1:])
        at = np.repeat(starts - places[:-1], sizes)
        at += np.arange(places[-1])
        return self.ids[at], places

    def forward_many(self, kinds: np.ndarray, lengths: np.ndarray, after: Callable, other: int) -> tuple[np.ndarray, ...]:
        """``forward`` for words as columns of characters, ``other`` below each of them: best scores, leads, whether pieces decode to
        the word (they do, as they cover it), numbers of ids, and the ids of one word after another."""
        longest, n = kinds.shape
        best, second = np.full((2, longest + 1, n), _NONE, np.int64)
        start_of, id_of = np.zeros((2, longest + 1, n), np.int32)
        best[0] = 0
        for start in range(longest):
            at = np.flatnonzero(kinds[start] != other)
            state = np.ones(len(at), np.int64)
            for end in range(start + 1, longest + 1):
                state = after(state, kinds[end - 1, at])
                on = np.flatnonzero(state)
                at, state = at[on], state[on]
                piece = self.state_id[state]
                full = np.flatnonzero(piece >= 0)
                rows, piece, score = at[full], piece[full], self.state_score[state[full]]
                total, old = best[start, rows] + score, best[end, rows]
                better = total > old
                second[end, rows] = np.maximum(np.maximum(second[end, rows], np.where(better, old, total)), second[start, rows] + score)
                better |= (total == old) & (piece < id_of[end, rows])
                won = rows[better]
                best[end, won], start_of[end, won], id_of[end, won] = total[better], start, piece[better]
                on = np.flatnonzero(state < self.going)
                if not len(on):
                    break
                at, state = at[on], state[on]
        steps, place, each = [], lengths, np.arange(n)
        while place.any():
            steps.append(np.where(place > 0, id_of[place, each], -1))
            place = start_of[place, each]
        ids = np.array(steps[::-1]).T
        some = ids >= 0
        total, runner = best[lengths, each], second[lengths, each]
        return total, np.where(runner > _NONE // 2, total - runner, _ALONE), np.ones(n, bool), some.sum(axis=1), ids[some].astype("<u4")

    def normalize(self, text: str) -> str:
        return self.processor.normalize(text)

    def uncovered(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass"))

    def forward(self, word: str) -> tuple[list[int], list[tuple[int, tuple[int, ...]]], int | None]:
        """Viterbi: best score of every prefix with its last step, and the lead of the best
        segmentation over the second (None if it is the only one)."""
        begins, length = self.begins, len(word)
        best, second, last = [_NONE] * (length + 1), [_NONE] * (length + 1), [(0, ())] * (length + 1)
        best[0] = 0

        def step(start: int, end: int, score: int, ids: tuple[int, ...]) -> None:
            total, old = best[start] + score, best[end]
            if total > old or (total == old and ids[::-1] < last[end][1][::-1]):
                best[end], last[end], runner = total, (start, ids), old
            else:
                runner = total
            second[end] = max(second[end], runner, second[start] + score)

        for start in range(length):
            for end in range(start + 1, length + 1):
                chars = word[start:end]
                if chars not in begins:
                    break
                if found := begins[chars]:
                    score, piece = found
                    total, old = best[start] + score, best[end]
                    if total > old:
                        best[end], last[end] = total, (start, (piece,))
                        total = old
                    elif total == old:
                        step(start, end, score, (piece,))
                        continue
                    if total > second[end]:
                        second[end] = total
                    if second[start] + score > second[end]:
                        second[end] = second[start] + score
            if word[start] not in self.pieces:
                step(start, start + 1, self.lowest, self.uncovered(word[start]))
        return best, last, best[-1] - second[-1] if second[-1] > _NONE // 2 else None

    @property
    def fresh(self) -> dict[str, tuple[int, tuple[int, ...], int | None, bytes, bytes]]:
        """What is known of words that a pass over many words has reached."""
        return {w: self.word(w) for w in self.row if len(w) <= LONGEST and all(c in self.pieces for c in w)}

    def word(self, word: str) -> tuple[int, tuple[int, ...], int | None, bytes, bytes]:
        """Best score and ids of a word, its lead, its ids packed, and the bytes that they decode to."""
        row = self.row.get(word)
        if row is None:
            return self.alone_word(word)
        ids, lead = tuple(self.ids[self.ends[row]:self.ends[row + 1]].tolist()), int(self.lead[row])
        return int(self.score[row]), ids, None if lead == _ALONE else lead, *self.packed(ids)

    def alone_word(self, word: str) -> tuple[int, tuple[int, ...], int | None, bytes, bytes]:
        """``word`` by a pass over this word only."""
        best, last, lead = self.forward(word)
        steps, at = [], len(word)
        while at:
            at, ids = last[at]
            steps.append(ids)
        flat = tuple([i for s in reversed(steps) for i in s])
        return best[-1], flat, lead, *self.packed(flat)

    def choices(self, word: str, n: int, limit: float) -> list[tuple]:
        """The n best of a word that lose at most ``limit``, by their pieces from the end: (pieces from the end, rank, loss, ids)."""
        reach, known = self.searched.get((word, n), (-1, []))
        if reach < limit:
            found = self.search(word, n, limit)
            known = sorted((s.ids[::-1], k, found[0].score - s.score, s.ids) for k, s in enumerate(found))
            if len(word) <= 32:
                if len(self.searched) >= KEPT // 8:
                    self.searched.clear()
                self.searched[word, n] = limit, known
        return known

    def lattice(self, word: str) -> tuple[list[int], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Best score of every prefix, and what can end at every place: (start, score, ids)."""
        begins, length = self.begins.get, len(word)
        best, into = [0] + [_NONE] * length, [[] for _ in range(length + 1)]
        for start in range(length):
            here = best[start]
            for end in range(start + 1, length + 1):
                found = begins(word[start:end], ())
                if found == ():
                    break
                if found:
                    score, piece = found
                    into[end].append((start, score, (piece,)))
                    if here + score > best[end]:
                        best[end] = here + score
            if word[start] not in self.pieces:
                into[start + 1].append((start, self.lowest, self.uncovered(word[start])))
                best[start + 1] = max(best[start + 1], here + self.lowest)
        return best, into

    def search(self, word: str, n: int, limit: float) -> list[Segmentation]:
        """Backward A-star over the lattice of one word: an end of a segmentation costs what the best
        segmentation with that end loses, by the forward scores.  Ends that cost more than ``limit`` are left."""
        best, into = self.lattice(word)
        ends: list[tuple] = [(0, len(word), None)]  # cost, place, ids of the piece there and what comes after it
        found: list[Segmentation] = []
        steps: dict[int, list[tuple]] = {}  # what can end at a place, in the order of its pieces from the end
        while ends and len(found) < n:
            at = min(range(len(ends)), key=lambda i: ends[i][0])
            cost, place, tail = ends[at]
            if place:
                nexts = steps.get(place)
                if nexts is None:
                    nexts = [(ids[::-1], c, start, ids) for start, score, ids in into[place] if (c := best[place] - best[start] - score) <= limit]
                    steps[place] = nexts = sorted(nexts) if len(nexts) > 1 else nexts
                replace(ends, at, [(cost + c, start, (ids, tail)) for _, c, start, ids in nexts if cost + c <= limit], n - len(found))
                continue
            del ends[at]
            ids = []
            while tail is not None:
                piece, tail = tail
                ids += piece
            found.append(Segmentation(best[-1] - cost, tuple(ids)))
        return found

    def nbest(self, text: str | None, n: int) -> list[tuple[int, list[tuple[int, ...]]]]:
        """The best segmentations of a text, as (score, ids by word)."""
        return self.nbest_words(self.words_of(text), n)

    def words_of(self, text: str | None) -> list[str]:
        normal = self.normalize(text or "")
        return ([normal] if normal else []) if self.whole else self.split(normal)

    def nbest_words(self, words: list[str], n: int) -> list[tuple[int, list[tuple[int, ...]]]]:
        self.learn(words)
        known = {w: self.word(w) for w in set(words)}
        best = [known[w][1] for w in words]
        leads = self.lead[[self.row[w] for w in words]]
        out = []
        for score, changes in self.ranked(words, sum([known[w][0] for w in words]), leads, n):
            ids = best.copy() if changes else best
            for at, segmentation in changes:
                ids[at] = segmentation
            out.append((score, ids))
        return out

    def ranked(self, words: list[str], total: int, leads: np.ndarray, n: int) -> list[tuple[int, list[tuple[int, tuple[int, ...]]]]]:
        """The best segmentations as (score, changes against the best segmentation of each word, the last word first)."""
        out = [(total, [])]
        if n > 1 and words:
            out += [(total - loss, changes) for changes, loss in self.along(words, leads, n) if changes]
        return out

    def encoded(self, words: list[str], n: int) -> list[tuple[int, bytes, int]]:
        """The best segmentations of a text as (score, packed ids, crc32 of the decoded text)."""
        return next(self.encoded_many([words], n))

    def encoded_many(self, texts: list[list[str]], n: int) -> Iterator[list[tuple[int, bytes, int]]]:
        """``encoded`` for each of many texts.

        Ids and sums of the best segmentations of words are put together for all texts at once.  A text is decoded from its
        ids only if a word is not what its pieces decode to, or if a change alters the bytes of a word."""
        coded = pa.array(chain.from_iterable(texts), pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn(names)
        rows = np.fromiter(map(self.row.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        ids, places = self.ids_of(rows)
        scores, leads, own = self.score[rows], self.lead[rows], self.own[rows]
        z = 0
        for words in texts:
            a, z = z, z + len(words)
            best = ids[places[a]:places[z]].tobytes()
            crc = crc_of([plain("".join(words))] if own[a:z].all() else [self.raw(ids[places[a]:places[z]].tolist())])
            out = []
            for score, changes in self.ranked(words, sum(scores[a:z].tolist()), leads[a:z], n):
                parts, done, same = [], len(best), True
                for at, other in changes:
                    start, end = 4 * int(places[a + at] - places[a]), 4 * int(places[a + at + 1] - places[a])
                    pack, raw = self.packed(other)
                    parts += best[end:done], pack
                    done = start
                    same = same and raw == (plain(words[at]) if own[a + at] else self.raw(ids[places[a + at]:places[a + at + 1]].tolist()))
                mine = b"".join([best[:done], *reversed(parts)]) if changes else best
                out.append((score, mine, crc if same else crc_of([self.raw(np.frombuffer(mine, "<u4").tolist())])))
            yield out

    def along(self, words: list[str], leads: np.ndarray, n: int) -> Iterator[tuple[list[tuple[int, tuple[int, ...]]], int]]:
        """The n best choices of segmentations along the chain: (changes against the best, loss).

        Words that change alone or together by their leads give segmentations, so none that loses more than the n-th best
        of these is among the n best; only words with leads up to that matter, and of equal words only the first and last ones."""
        least = [0]
        for lead in sorted((np.partition(leads, n - 2)[:n - 1] if len(leads) >= n else leads).tolist()):
            if lead < _ALONE:
                least = sorted(least + [x + lead for x in least])[:n]
        limit = least[n - 1] if len(least) >= n else math.inf
        places: dict[str, list[int]] = {}
        for at in np.flatnonzero(leads <= limit if limit < _ALONE else leads < _ALONE).tolist():
            places.setdefault(words[at], []).append(at)
        if not places:
            yield [], 0
            return
        taken = []
        for at in places.values():
            taken += at if len(at) <= 2 * n else at[:n] + at[-n:]
        taken.sort(reverse=True)
        choices: dict[str, list[tuple]] = {}
        for at in taken:
            w = words[at]
            if w not in choices:
                choices[w] = self.choices(w, n, limit)
        ends: list[tuple] = [(0, 0, ())]
        given = 0
        while ends and given < n:
            here = min(range(len(ends)), key=lambda i: ends[i][0])
            loss, done, changes = ends[here]
            if done == len(taken):
                given += 1
                del ends[here]
                yield list(changes), loss
                continue
            at = taken[done]
            replace(ends, here, [(loss + more, done + 1, (*changes, (at, ids)) if k else changes) for _, k, more, ids in choices[words[at]] if loss + more <= limit], n - given)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of a segmentation; the space that normalisation puts in front goes again."""
        return text_of(self.raw(ids))

    def raw(self, ids: Iterable[int]) -> bytes:
        """The bytes that pieces stand for."""
        try:
            return b"".join([self.surface[i] for i in ids])
        except KeyError:  # ids that stand for no text
            return b"".join([self.surface.get(i, b"") for i in ids])

    def packed(self, ids: tuple[int, ...]) -> tuple[bytes, bytes]:
        """Ids of a word as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        return struct.pack(f"<{len(ids)}I", *ids), self.raw(ids)


def plain(word: str) -> bytes:
    """The bytes that pieces of a word decode to if they cover it."""
    return word.replace(SPACE, " ").encode("utf-8", "surrogatepass")


def text_of(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").removeprefix(" ")


def encode_nbest(docs: DataFrame, path: str, n: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per segmentation: ``doc_id, rank`` (from 1), ``score, n_pieces, ids_crc32`` (ids as little-endian unsigned 32-bit
    integers), ``text_crc32`` (of the decoded text) and, unless left out, ``ids``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in blocks(batch, 1, TEXT_BYTES):
                out, texts = [], [m.words_of(text.as_py()) for text in part.column(1)]
                for i, found in enumerate(m.encoded_many(texts, n)):
                    for rank, (score, ids, text_crc) in enumerate(found, 1):
                        out.append((i, rank, score / UNIT, len(ids) // 4, zlib.crc32(ids), text_crc, *([np.frombuffer(ids, "<i4")] if keep_ids else [])))
                cols = list(zip(*out))
                kinds = [pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *map(pa.array, cols[1:], kinds)],
                                                 ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "text_crc32", "ids"][:6 + keep_ids])

    return rows.mapInArrow(run, f"doc_id {kind}, rank int, score double, n_pieces long, ids_crc32 long, text_crc32 long" + ", ids array<int>" * keep_ids)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of each list of ids (null for null)."""
    from pyspark.sql.types import StringType, StructField, StructType

    rows = rows.drop("decoded")
    names, at = rows.columns, rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if x is None else m.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))

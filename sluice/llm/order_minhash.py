"""Near-duplicate detection by order MinHash, verified by banded alignment.

A text is its sequence of words (letters, digits and underscore, each lower-cased);
its k-mers are runs of ``K`` words, each labelled with how many equal ones came
before it.  A sketch samples the ``PICK`` labelled k-mers that a random order
puts first and keeps them in the order of the text, so it tells texts apart
that hold the same k-mers in another order.  Two texts are candidates if any of
``SKETCHES`` sketches agree.  Texts of at most ``SHORT`` words are sketched with
``PICK_SHORT`` k-mers; lengths that can have a copy on both sides have both kinds.

A candidate pair is verified by an alignment of the two word sequences within
the band that the threshold allows: similarity = matched / (words of both -
matched) >= ``SIMILAR``.  Classes are the connected components of verified pairs.

Work per bucket stays linear for groups of copies: equal word sequences are
one node; each bucket's members are first aligned with leaders (22 at most), and
only members that are then still in different classes are paired with each other
(none is left out).  Leaders come from pre-aggregated maxima, joins may be
split by key, and pairs, links and components never leave the executors.

What is found: a pair shares a sketch with a chance of
1 - (1 - s ** PICK) ** SKETCHES, s being the share of equal labelled words, if
their order is the same.  s is never below the aligned similarity, so a pair at
the threshold itself (0.8) has a chance above 0.9999; a word that is repeated
often changes its label with each edit before it, which costs long texts some
of it.  Pairs whose marks differ in more places than the threshold allows words
to differ cannot pass the alignment and are left out before it.

Null text counts as empty; texts without words are copies only if they are equal.
Of fewer than five words only equal texts reach the threshold.  Repeated rows and
ids share a class if their texts do; null ids come last.  Long texts are sketched
and aligned whole, some sketches at a time.  Other columns are not read (``keep_one``
keeps them, whatever their names).  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sluice.llm.components import components
from sluice.llm.shared import cut
from sluice.llm.words import blocks, text_bytes

#: Words of a k-mer, k-mers of a sketch, sketches of a text, and the similarity from which texts are copies.
K, PICK, SKETCHES, SIMILAR = 1, 7, 64, 0.8
#: Longest text, in words, that is sketched as a short one, and the k-mers of its sketches.
SHORT, PICK_SHORT = 16, 4
#: 64-bit words of a text's mark.
MARKS = 16
SEED = 1
#: Of each round: one in so many buckets holds it, and its members are aligned with leaders of so many of its classes.
FIRST = 8
ROUNDS = ((FIRST, 1), (1, 1), (1, 4), (1, 16))
#: Hashes held at once while sketching a long text, and bytes of text that are cut into words at once.
CELLS, TEXT_BYTES = 1 << 18, 1 << 18

_WORD = re.compile(r"\w+")
_U = np.uint64
#: An odd base of the running hash over characters, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall("".join([c.lower() if len(c.lower()) == 1 else c for c in text or ""]))


class Characters:
    """What every character is: part of a word or not, and its lower case (itself where that is no single character)."""

    _known = None

    def __init__(self):
        every = range(0x110000)
        self.word = np.fromiter((c.isalnum() or c == "_" for c in map(chr, every)), bool, len(every))
        self.lower = np.fromiter((ord(low) if len(low := c.lower()) == 1 else ord(c) for c in map(chr, every)), np.uint32, len(every))
        self.powers = self.inverses = np.ones(1, np.uint64)

    @classmethod
    def known(cls) -> "Characters":
        cls._known = cls._known or cls()
        return cls._known

    def up_to(self, n: int) -> None:
        """Powers of the base and of its inverse, for a running hash over ``n`` characters."""
        if len(self.powers) < n:
            steps = np.arange(n) > 0
            self.powers = np.cumprod(np.where(steps, _U(_BASE), _U(1)))
            self.inverses = np.cumprod(np.where(steps, _U(_INVERSE), _U(1)))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of an array of texts, and the number of words of each text."""
    offsets, raw = text_bytes(texts)
    known = Characters.known()
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edges = before[offsets]
    word = np.zeros(len(points) + 2, bool)
    word[1:-1] = known.word[points]
    first = np.zeros(len(points) + 1, bool)
    first[edges] = True
    start = np.flatnonzero(word[1:] & (first | ~word[:-1]))
    end = np.flatnonzero(word[:-1] & (first | ~word[1:]))
    known.up_to(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((known.lower[points].astype(np.uint64) + _U(1)) * known.powers[:len(points)], out=total[1:])
    hashes = (total[end] - total[start]) * known.inverses[start]
    return mix(hashes + mix((end - start).astype(np.uint64))), np.diff(np.searchsorted(start, edges))


def word_codes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(32)).astype(np.uint32)


def coded_rows(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Name and word codes of every text."""
    hashes, sizes = word_hashes(texts)
    for text, mine in zip(texts, np.split(hashes, np.cumsum(sizes)[:-1])):
        yield node_of(mine, text), word_codes(mine)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in the order of the text."""
    n = max(1, len(codes) - k + 1)
    out = np.full(n, _U(len(codes) if len(codes) < k else k))
    for i in range(min(k, len(codes))):
        out = mix(out * _U(0x9E3779B97F4A7C15) + codes[i:i + n].astype(_U))
    return out


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash combined with the number of equal ones before it."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(ranked))
    before = np.empty(len(ranked), np.uint64)
    before[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mix(hashes + mix(before))


def mark(marked: np.ndarray) -> np.ndarray:
    """Parities of the labelled words in 64 * MARKS places: two marks differ in at most as many places as their texts in words."""
    return np.packbits(np.bincount((marked >> _U(40)).astype(np.int64) % (64 * MARKS), minlength=64 * MARKS).astype(np.uint8) & 1).view(np.int64)


def sketches_of(codes: np.ndarray) -> np.ndarray:
    """The sketches of a text, of both kinds where copies can be of either."""
    kinds = []
    if len(codes) <= SHORT:
        kinds.append(mix(sketch(codes, pick=PICK_SHORT)))
    if len(codes) >= SIMILAR * (SHORT + 1):
        kinds.append(sketch(codes))
    return np.concatenate(kinds)


def sketch(codes: np.ndarray, sketches: int = SKETCHES, pick: int = PICK) -> np.ndarray:
    """One 64-bit value for every sketch."""
    plain = kmers(codes)
    marked = labelled(plain)
    n, salts = len(marked), mix(np.arange(1, sketches + 1, dtype=np.uint64) + _U(SEED << 32)) | _U(1)
    out = np.empty(sketches, np.uint64)
    step = max(1, CELLS // n)
    for a in range(0, sketches, step):
        salt = salts[a:a + step, None]
        best = np.tile(np.arange(n), (len(salt), 1)) if n <= pick else least(marked[None, :] * salt, pick)
        best.sort(axis=1)
        value = salt[:, 0]
        for col in best.T:
            value = mix(value * _U(0x9E3779B97F4A7C15) + plain[col])
        out[a:a + step] = value
    return out


def least(order: np.ndarray, pick: int) -> np.ndarray:
    """Columns of the ``pick`` smallest values of each row.  The values are as good as random: few lie below a bound
    that nearly always has enough of them below it; else all are looked at."""
    rows, n = order.shape
    below = 3 * pick + 12
    if n > 4 * below:
        at = np.flatnonzero(order < _U(int(below / n * 2.0 ** 64)))
        row, column = np.divmod(at, n)
        counts = np.bincount(row, minlength=rows)
        if counts.min() >= pick:
            place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            values = np.full((rows, counts.max()), ~_U(0))
            columns = np.zeros(values.shape, np.int64)
            values[row, place], columns[row, place] = order[row, column], column
            return np.take_along_axis(columns, np.argpartition(values, pick - 1, axis=1)[:, :pick], axis=1)
    return np.argpartition(order, pick - 1, axis=1)[:, :pick]


def matched(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words that the best alignment within the band matches.

    Rows of the alignment are bit sets (one step per word of ``b``); matches
    farther than ``band`` from the diagonal do not count."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head:][::-1] != b[len(b) - n + head:][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    a, b = a[head:len(a) - tail].tolist(), b[head:len(b) - tail].tolist()
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    window = (1 << 2 * band + 1) - 1
    for j, w in enumerate(b):
        hit = places.get(w)
        if hit:
            hit &= window << j - band if j >= band else window >> band - j
            hit &= row
            row = ((row + hit) | (row - hit)) & full
    return head + tail + len(a) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    need = least / (1 + least) * total
    return matched(a, b, int(total - 2 * need) + 1) >= need - 1e-9


def node_of(hashes: np.ndarray, text: pa.StringScalar) -> bytes:
    """Name of a word sequence; a text without words is named after itself."""
    raw = hashes.tobytes() if len(hashes) else b"\0" + (text.as_py() or "").encode()
    return hashlib.blake2b(raw, digest_size=16).digest()


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, node`` (name of the word sequence), ``n`` (words), ``mark`` and ``sketch`` (none without words) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, TEXT_BYTES):
                nodes, sizes, marks, sketches = [], [], [], []
                for node, codes in coded_rows(part.column(1)):
                    nodes.append(node)
                    sizes.append(len(codes))
                    marks.append(mark(labelled(kmers(codes, 1))) if len(codes) else np.zeros(MARKS, np.int64))
                    sketches.append(sketches_of(codes).view(np.int64) if len(codes) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), lists(marks), lists(sketches)],
                    ["doc_id", "node", "n", "mark", "sketch"])

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values)))

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, node binary, n int, mark array<long>, sketch array<long>")


def sequences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``node, words`` (codes of its words) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0, TEXT_BYTES):
                rows = list(coded_rows(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary())], ["node", "words"])

    return docs.select(text).mapInArrow(run, "node binary, words binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that an alignment confirms.  ``texts``: ``node, words``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(c), F.col("words").alias("w" + c)) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def near(a: str, b: str, mark_a: str, mark_b: str) -> Column:
    """Lengths and marks allow the similarity."""
    places = sum((F.bit_count(F.col(mark_a)[i].bitwiseXOR(F.col(mark_b)[i])) for i in range(MARKS)), F.lit(0))
    apart = (F.col(a) + F.col(b)) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6
    return (F.least(a, b) >= F.greatest(a, b) * SIMILAR) & (places <= apart)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs ``a, b`` of nodes that an alignment confirms.  ``texts``: ``node, words``."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "omh-pairs")
    return cut(verified(pairs, texts), "omh-links")


def labelled_rows(rows: DataFrame, node: str, labels: DataFrame, name: str) -> DataFrame:
    """``rows`` with the label of their ``node`` (itself if it has none) as ``name``."""
    return rows.join(labels.toDF(node, name), node, "left").withColumn(name, F.coalesce(name, node))


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their ``label``, of the buckets that hold several classes."""
    marked = cut(labelled_rows(members, "node", labels, "label"), "omh-marked")
    apart = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return cut(marked.join(apart, "key"), "omh-open")


def link(members: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """Classes of the nodes in buckets: ``node, label``.  ``members``: ``key, node``; ``known``: ``node, n, mark, weight``.

    In a few rounds every bucket aligns its members with leaders: the member that shares most buckets (the text that
    copies were made from), then such members of classes that have not led yet, more of them in each round, so that what
    belongs together soon is one class.  The first round is held by one in ``FIRST`` of the buckets: copies share
    many, and a pair that has met in one need not meet in the others.  All buckets come after it.  Members meet
    leaders by bucket, and what is left is made distinct before the alignment; lengths and marks are joined once, to
    members of buckets that then hold several classes, and stay with them.  Members that are still in different classes
    are then paired with each other."""
    labels, links, led = None, None, None
    foremost = Window.partitionBy("key").orderBy(F.desc("leader.weight"), F.desc("leader.node"))
    for share, most in ROUNDS:
        some = members if share == 1 else members.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)
        rows = some.withColumn("label", F.col("node")) if labels is None else still_open(some, labels)
        if "mark" not in rows.columns:
            rows = cut(rows.join(known, "node"), "omh-rows")
        if share == 1:
            members = rows.drop("label")
            if members.isEmpty():
                return labels
        heads = rows.groupBy("key", "label").agg(F.max(F.struct("weight", "node", "n", "mark")).alias("leader"))
        if led is not None:
            heads = heads.join(labelled_rows(led, "leader", labels, "label").select("key", "label"), ["key", "label"], "left_anti")
        leaders = heads.withColumn("place", F.row_number().over(foremost)).filter(F.col("place") <= most)
        leaders = cut(leaders.select("key", "leader.node", "leader.n", "leader.mark", "label").toDF("key", "leader", "leader_n", "leader_mark", "leader_label"), "omh-leaders")
        met = rows.join(leaders, "key").filter((F.col("label") != F.col("leader_label")) & near("n", "leader_n", "mark", "leader_mark"))
        new = confirm(met.select(F.col("leader").alias("a"), F.col("node").alias("b")), texts)
        links = new if links is None else labels.toDF("a", "b").union(new)
        labels = cut(components(links), "omh-labels")
        led = leaders.select("key", "leader") if led is None else led.union(leaders.select("key", "leader"))
    members = still_open(members, labels)
    if members.isEmpty():
        return labels
    # lengths within the threshold share one of two neighbouring length classes
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(1 / SIMILAR)) + 1e-9)
    spread = members.withColumn("size", F.explode(F.array(step, step + 1)))
    x, y = spread.alias("x"), spread.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node"))
                  & (F.col("x.label") != F.col("y.label")) & near("x.n", "y.n", "x.mark", "y.mark"))
    more = confirm(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), texts)
    return components(more.union(labels.toDF("a", "b")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, node, class_id`` (least document id of its class), ``class_node`` (that document's node)."""
    table = cut(sketched(docs, doc_id, text), "omh-sketches")
    rows = table.select(F.explode("sketch").alias("key"), "node")
    # keys of several rows first, by the keys alone; copies of one text are one member
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    met = cut(rows.join(several.hint("merge"), "key").distinct(), "omh-met")
    shared_keys = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(met.join(shared_keys, "key"), "omh-members")
    weights = cut(members.groupBy("node").agg(F.sum("size").alias("weight")), "omh-weights")
    texts = sequences(docs, text).join(weights.select("node").hint("merge"), "node", "left_semi")
    texts = cut(texts.groupBy("node").agg(F.first("words").alias("words")), "omh-texts")
    known = cut(weights.join(table.groupBy("node").agg(F.first("n").alias("n"), F.first("mark").alias("mark")), "node"), "omh-known")
    labels = link(members.select("key", "node"), known, texts)

    ids = table.groupBy("node").agg(F.min("doc_id").alias("least"))
    marked = cut(ids.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "omh-labels")
    # a null id is the last of all
    heads = cut(marked.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("head")), "omh-heads")
    named = cut(marked.join(heads, "label").select("node", F.col("head.least").alias("class_id"), F.col("head.node").alias("class_node")), "omh-classes")
    return table.select("doc_id", "node").join(named, "node").select("doc_id", "node", "class_id", "class_node")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every class: the one of least id (null ids come last); of several rows of that id and
    word sequence, the one of the least hash of all its columns."""
    found = classes(docs, doc_id, text)
    heads = found.filter(F.col("node") == F.col("class_node")).select("class_id", F.col("node").alias("class_node")).distinct()
    names = docs.columns
    at, own = names.index(text), "__name"
    while own in names:
        own += "_"

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at, TEXT_BYTES):
                nodes = [node for node, _ in coded_rows(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.binary())], [*names, own])

    named = docs.mapInArrow(name, StructType([*docs.schema.fields, StructField(own, BinaryType())]))
    kept = named.join(heads, named[doc_id].eqNullSafe(heads["class_id"]) & (named[own] == heads["class_node"]), "left_semi")
    one = kept.groupBy(doc_id, own).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    return one.select("row.*")

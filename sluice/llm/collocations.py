"""Phrase collocations by SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends and
into words at space and tab.  A phrase is two to ``LONGEST`` words of one piece; all
its occurrences count, overlapping ones too, per language.

1. Words are counted per language; only words of full support can be in a phrase.
2. A shard is a run of texts in a task.  It is mined completely, level by level
   (a run of words is counted if both its shorter runs are frequent), at a local
   support lowered in proportion to the shard's words of the language, and to
   ``LOCAL`` at most.  A phrase of full support reaches it in one shard at least.  Pairs are mined and counted
   (steps 3 and 4) before longer phrases, which then grow from the pairs of full
   support only: where shards are so many that the lowered support is 1, a shard
   reports its pairs and little more.
3. The union of the shards' phrases is taken.  What a shard did not report occurs
   there fewer times than its local support, so a phrase whose reported count and
   these remainders stay below the support is no candidate.  All others are
   candidates, and so are their parts.
4. Every candidate is counted in all texts, exactly, along a tree of words.

Words of full support and candidates are broadcast in bounded numbers: beyond
``WORDS`` words the shards are mined without that set (local support alone prunes
them), beyond ``CANDIDATES`` candidates are counted in several scans, each for the
phrases of some first words.  Both ways give the same result.

A phrase is cut after its first k words at the k of the lowest score
floor(1000 * f(phrase) * n / (f(first) * f(rest))), the smallest k among ties; n
counts all words of the language.  Products are decimals of 38 digits.  Phrases
inside a longer candidate of ``COVERED`` percent of their count or more are dropped.

Null text counts as empty, a null language as ``und``.  Repeated rows count as often
as they come; long texts are counted whole and may be cut between pieces; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import cut
from sluice.llm.words import Cutter, Words, blocks, counted

#: Occurrences of a phrase, words of the longest one, and the percentage of a longer phrase that covers it.
SUPPORT, LONGEST, COVERED = 100, 5, 100
#: Entries in one broadcast: words of full support, and candidates.
WORDS, CANDIDATES = 1 << 20, 1 << 20
#: Candidates in one vector of counts, and vectors that are added up at once.
VECTOR, ADDED = 4096, 256
#: Local support is never above this: a low one costs a shard little and leaves few candidates that are no results.
LOCAL = 2
#: Bytes of text in a shard, and of text that is cut into words at once.
SHARD_BYTES, CUT_BYTES = 16 << 20, 6 << 20
#: Phrases reported per language.
TOP = 2000

_CUTTER = Cutter(b" \t", b".,;:!?\n\x0b\x0c\r")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n``.  ``docs``: ``lang, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, CUT_BYTES):
                found = _CUTTER.cut(part.column(1))
                langs, words = part.column(0).dictionary_encode(), found.words.dictionary_encode()
                wide = max(1, len(words.dictionary))
                keys, _, n = counted(langs.indices.to_numpy().astype(np.int64)[found.row] * wide + words.indices.to_numpy())
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // wide)), words.dictionary.take(pa.array(keys % wide)), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """Words of full support by language, numbered; a unit is such a pair."""

    langs: pa.Array
    words: pa.Array
    #: Sorted lang * words + word of the units.
    keys: np.ndarray

    @staticmethod
    def of(langs: pa.Array, words: pa.Array) -> "Units":
        coded_langs, coded = langs.dictionary_encode(), words.dictionary_encode()
        wide = max(1, len(coded.dictionary))
        return Units(coded_langs.dictionary, coded.dictionary, np.unique(coded_langs.indices.to_numpy().astype(np.int64) * wide + coded.indices.to_numpy()))

    def find(self, langs: pa.Array, row: np.ndarray, words: pa.Array) -> np.ndarray:
        """Unit of each word, -1 if it is none.  ``langs`` are those of the rows."""
        if not len(self.keys) or not len(words):
            return np.full(len(words), -1, np.int64)
        coded = words.dictionary_encode()
        word = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy()[coded.indices.to_numpy()]
        lang = pc.fill_null(pc.index_in(langs, value_set=self.langs), -1).to_numpy()[row]
        out = np.full(len(words), -1, np.int64)
        some = np.flatnonzero((word >= 0) & (lang >= 0))
        key = lang[some] * np.int64(len(self.words)) + word[some]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[at] == key
        out[some[same]] = at[same]
        return out

    def texts(self, units: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(self.keys[units] % len(self.words)))

    def langs_of(self, units: np.ndarray) -> np.ndarray:
        return self.keys[units] // max(1, len(self.words))


def mined(docs: DataFrame, frequent, totals: dict[str, int], support: int, longest: int, pairs=None) -> DataFrame:
    """``lang, phrase, n, slack``: locally frequent phrases of every shard, and a row of null phrase per shard and language.
    ``slack`` is what a phrase that the shard does not report may occur there.  ``frequent``: broadcast Units, or None.
    With ``pairs`` (broadcast Tree of the pairs of full support) only phrases of three words or more are mined, from those pairs."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("slack", pa.int64())])

    def rows(langs, phrases, n, slack) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(n, pa.int64()), pa.array(slack, pa.int64())], schema=schema)

    def mine(units: Units, unit: np.ndarray, joined: np.ndarray, words_here: Counter) -> Iterator[pa.RecordBatch]:
        local = {lang: max(1, min(LOCAL, -(-support * n // totals[lang]))) for lang, n in words_here.items()}
        yield rows(pa.array(list(local)), pa.nulls(len(local), pa.string()), np.zeros(len(local), np.int64), np.array(list(local.values())) - 1)
        least = np.array([local.get(lang, 1) for lang in units.langs.to_pylist()], np.int64)
        run_at, texts, first, smallest = unit, None, None, 2
        if pairs is not None:
            level = pairs.value.levels[0][0]
            run_at, first, smallest = pairs.value.step(unit, unit, joined, 2), level // len(units.keys), 3
            texts = pc.binary_join_element_wise(units.texts(first), units.texts(level % len(units.keys)), " ")
        for size in range(smallest, longest + 1):
            at = np.flatnonzero((run_at[:-1] >= 0) & (run_at[1:] >= 0) & joined[size - 1:])
            keys, place, n = counted(run_at[at] * np.int64(len(units.keys)) + unit[at + size - 1])
            head, last = np.divmod(keys, max(1, len(units.keys)))
            start = head if first is None else first[head]
            lang = units.langs_of(start)
            keep = np.flatnonzero(n >= least[lang])
            if not len(keep):
                break
            head, last, start, lang, n = head[keep], last[keep], start[keep], lang[keep], n[keep]
            left = units.texts(head) if texts is None else texts.take(pa.array(head))
            texts, first = pc.binary_join_element_wise(left, units.texts(last), " "), start
            yield rows(units.langs.take(pa.array(lang)), texts, n, least[lang] - 1)
            number = np.full(len(keys), -1, np.int32)
            number[keep] = np.arange(len(keep))
            run_at = np.full(len(run_at) - 1, -1, np.int32)
            run_at[at] = number[place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a shard is kept as the numbers of its words alone; its texts go block by block
        unit, joined, words_here, size = [], [], Counter(), 0
        for batch in batches:
            for part in blocks(batch, 1, CUT_BYTES):
                found, langs = _CUTTER.cut(part.column(1)), part.column(0)
                if not len(found.words):
                    continue
                alone = pairs is None and frequent is None
                units = Units.of(langs.take(pa.array(found.row)), found.words) if alone else pairs.value.units if pairs is not None else frequent.value
                unit.append(units.find(langs, found.row, found.words).astype(np.int32))
                joined.append(found.joined)
                own = langs.dictionary_encode()
                here = np.bincount(own.indices.to_numpy()[found.row], minlength=len(own.dictionary)).tolist()
                words_here.update({lang: n for lang, n in zip(own.dictionary.to_pylist(), here) if n})
                size += int(found.offsets[-1])
                if alone or size >= SHARD_BYTES:
                    yield from mine(units, np.concatenate(unit), np.concatenate(joined), words_here)
                    unit, joined, words_here, size = [], [], Counter(), 0
                    pa.default_memory_pool().release_unused()
        if unit:
            yield from mine(units, np.concatenate(unit), np.concatenate(joined), words_here)

    return docs.mapInArrow(run, "lang string, phrase string, n long, slack long")


@dataclass
class Tree:
    """Candidates by size: sorted (place of the phrase without its last word) * units + last word, and their numbers."""

    units: Units
    levels: list[tuple[np.ndarray, np.ndarray]]
    size: int

    @staticmethod
    def of(langs: pa.Array, phrases: pa.Array) -> "Tree":
        """A tree of phrases (number = place in the arrays) that holds, with each phrase, all its beginnings of two words or more."""
        split = pc.split_pattern(phrases, " ")
        sizes = pc.list_value_length(split).to_numpy() if len(split) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        words = split.flatten()
        units = Units.of(langs.take(pa.array(row)), words)
        unit = units.find(langs, row, words)
        begin = np.cumsum(sizes) - sizes
        place = unit[begin] if len(sizes) else begin
        levels = []
        for size in range(2, int(sizes.max(initial=1)) + 1):
            grown = np.flatnonzero(sizes >= size)
            keys = place[grown] * len(units.keys) + unit[begin[grown] + size - 1]
            level, at = np.unique(keys, return_inverse=True)
            numbers = np.full(len(level), -1, np.int64)
            whole = sizes[grown] == size
            numbers[at[whole]] = grown[whole]
            levels.append((level, numbers))
            place[grown] = at
        return Tree(units, levels, len(sizes))

    def step(self, run_at: np.ndarray, unit: np.ndarray, joined: np.ndarray, size: int) -> np.ndarray:
        """Places among the candidates' beginnings of ``size`` words of the runs that start at each word (-1: none), from those of one word less."""
        level = self.levels[size - 2][0]
        at = np.flatnonzero((run_at[:-1] >= 0) & (unit[size - 1:] >= 0) & joined[size - 1:])
        keys = run_at[at] * np.int64(len(self.units.keys)) + unit[at + size - 1]
        place = np.minimum(np.searchsorted(level, keys), len(level) - 1)
        same = level[place] == keys
        out = np.full(len(run_at) - 1, -1, np.int32)
        out[at[same]] = place[same]
        return out

    def count(self, langs: pa.Array, found: Words) -> np.ndarray:
        unit = self.units.find(langs, found.row, found.words)
        out, run_at = np.zeros(self.size, np.int64), unit
        for size, (level, numbers) in enumerate(self.levels, 2):
            run_at = self.step(run_at, unit, found.joined, size)
            hits = np.bincount(run_at[run_at >= 0], minlength=len(level))
            out[numbers[numbers >= 0]] += hits[numbers >= 0]
        return out


def exact_counts(docs: DataFrame, candidates: DataFrame, size: int, limit: int) -> DataFrame:
    """``lang, phrase, n`` of the ``size`` candidates (``lang, phrase``), counted in all texts."""
    spark, scans = docs.sparkSession, max(1, -(-size * 5 // (4 * limit)))
    first = F.substring_index("phrase", " ", 1)
    candidates = cut(candidates.select("lang", "phrase", F.pmod(F.xxhash64("lang", first), F.lit(scans)).alias("scan"), F.monotonically_increasing_id().alias("id")), "candidates")
    counts = None
    for scan in range(scans):
        some = candidates.filter(F.col("scan") == scan).select("id", "lang", "phrase").toArrow().combine_chunks()
        ids, langs, phrases = (_whole(some[c], kind) for c, kind in (("id", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())))
        tree = spark.sparkContext.broadcast((Tree.of(langs, phrases), ids.to_numpy()))
        vectors = docs.mapInArrow(_counting(tree), "part int, vector int, n array<long>")
        # sums of bounded groups of tasks, then of these sums
        few = vectors.withColumn("part", F.floor(F.col("part") / ADDED).cast("int")).groupBy("vector", "part").applyInArrow(_added, "part int, vector int, n array<long>")
        one = cut(few.groupBy("vector").applyInArrow(_named(tree), "id long, n long"), "phrase-counts")
        counts = one if counts is None else counts.union(one)
    return candidates.join(counts, "id").select("lang", "phrase", "n")


def _counting(tree):
    """Counts of all candidates in a task's texts, as vectors of ``VECTOR`` counts each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, _), total = tree.value, None
        for batch in batches:
            for part in blocks(batch, 1, CUT_BYTES):
                n = known.count(part.column(0), _CUTTER.cut(part.column(1)))
                total = n if total is None else total + n
        for at in range(0, 0 if total is None else len(total), VECTOR):
            if total[at:at + VECTOR].any():
                yield _vector(TaskContext.get().partitionId(), at // VECTOR, total[at:at + VECTOR])
    return run


_COUNTS = pa.schema([("part", pa.int32()), ("vector", pa.int32()), ("n", pa.list_(pa.int64()))])


def _vector(part: int, vector: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "vector": vector, "n": counts}], _COUNTS)


def _sum(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.sum([v.values.to_numpy() for v in vectors], axis=0)


def _added(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_vector(0, table["vector"][0].as_py(), _sum(table["n"]))])


def _named(tree):
    def run(table: pa.Table) -> pa.Table:
        at, n = table["vector"][0].as_py() * VECTOR, _sum(table["n"])
        return pa.table({"id": tree.value[1][at:at + len(n)], "n": n}).filter(pc.greater(pc.field("n"), 0))
    return run


def _whole(column: pa.ChunkedArray | pa.Array, kind: pa.DataType) -> pa.Array:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return pa.concat_arrays([c.cast(kind) for c in chunks] or [pa.array([], kind)])


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", support: int = SUPPORT, longest: int = LONGEST,
            words_limit: int = WORDS, candidates_limit: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Exact counts ``lang, phrase, n`` of all runs of one to ``longest`` words of full support, and ``lang, n`` of all words."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = cut(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = cut(words.filter(F.col("n") >= support), "frequent-words")
    known = None
    if (n_words := frequent.count()) <= words_limit:
        table = frequent.select("lang", "word").toArrow()
        known = spark.sparkContext.broadcast(Units.of(_whole(table["lang"], pa.string()), _whole(table["word"], pa.string())))
    by_lang = {r["lang"]: r["n"] for r in totals.collect()}
    found = frequent.select("lang", F.col("word").alias("phrase"), "n")
    if not n_words:
        return found, totals
    two = _phase(mined(docs, known, by_lang, support, 2), docs, support, candidates_limit)
    # longer phrases grow from the pairs of full support; too many of these for a broadcast leave local support to do it
    pairs = None
    if (n_pairs := two.count()) and n_pairs <= candidates_limit:
        table = two.select("lang", "phrase").toArrow()
        pairs = spark.sparkContext.broadcast(Tree.of(_whole(table["lang"], pa.string()), _whole(table["phrase"], pa.string())))
    if not n_pairs:
        return found, totals
    longer = mined(docs, known, by_lang, support, longest, pairs).filter(F.col("phrase").isNull() | (F.size(F.split("phrase", " ")) > 2))
    return found.union(two).union(_phase(longer, docs, support, candidates_limit)), totals


def _phase(shards: DataFrame, docs: DataFrame, support: int, limit: int) -> DataFrame:
    """Exact counts of the mined phrases that can have full support, and have it."""
    shards = cut(shards, "mined-phrases")
    slack = shards.filter("phrase IS NULL").groupBy("lang").agg(F.sum("slack").alias("all_slack"))
    union = shards.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack"))
    possible = union.join(F.broadcast(slack), "lang").filter(F.col("n") + F.col("all_slack") - F.col("slack") >= support)
    possible = cut(possible.select("lang", "phrase"), "possible-phrases")
    return cut(exact_counts(docs, possible, possible.count(), limit).filter(F.col("n") >= support), "phrases")


def collocations(docs: DataFrame, covered: int = COVERED, **options) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of the phrases of two words or more that no longer one covers."""
    found, totals = phrases(docs, **options)
    found = cut(found.select("lang", "phrase", "n", F.split("phrase", " ").alias("w")), "phrases")
    several = found.filter(F.size("w") > 1)
    whole = lambda part: F.array_join(part, " ")

    # a longer phrase that covers covers with its two beginnings and ends one word shorter as well, as counts only grow on the way
    longer = several.filter(F.size("w") > 2)
    inner = longer.select("lang", "n", F.explode(F.array(whole(F.slice("w", F.lit(1), F.size("w") - 1)), whole(F.slice("w", F.lit(2), F.size("w") - 1)))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = several.join(most, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("n") * covered, F.lit(True)))

    parts = kept.select("lang", "phrase", "n", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w")
    parts = parts.select("lang", "phrase", F.col("n").alias("a"), "k", F.size("w").alias("words"), whole(F.slice("w", F.lit(1), F.col("k"))).alias("left"),
                         whole(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right"))
    parts = parts.join(found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    parts = parts.join(found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(F.broadcast(totals), "lang")
    scored = parts.withColumn("score", score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "best.words", "best.a", "best.l", "best.r", "best.n", "best.score")


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)), exact up to 10^17 words."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    return F.call_function("div", (wide(a) * wide(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of every language by score, count and phrase, with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

"""Source divergence audit: how far the term use of a source lies from others of its language.

Terms are runs of letters a-z (A-Z lower-cased) and characters beyond ASCII.  A
language keeps the terms of at least ``LEAST_DOCS`` of its documents.  A group's
smoothed share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)): N counts
the group's occurrences of kept terms, V the language's kept terms.  Sources are
compared by the sum of f(p, q) = floor((p - q)^2 / q) over all kept terms, also
those that neither source has.

Counts come in one pass over the texts, added up per block of texts before the
shuffle.  For the sums the vocabulary of a language is reordered so that terms of
equal counts lie together (its distinct count vectors, sorted, each with the number
of its terms), and cut into blocks.  In a block every source is a run-length
encoded column; the runs of two columns are intersected at their boundaries, f is
taken once for each common run and multiplied by its length.  Blocks are
independent and their partial sums are added, so no task holds a vocabulary.

Arithmetic is exact: shares by long division in base 1000, sums of at most
(SCALE + V)^2, which 64 bits hold.

Null text, language and source count as ''.  Groups without terms have p = 1 +
floor(SCALE / V) for every kept term; languages without kept terms have sums of 0.
Long texts are counted whole, repeated rows count as often as they come, ids and
other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import cut
from sluice.llm.words import Cutter, blocks, counted

#: Documents of a language that a kept term occurs in at least, and the denominator of shares.
LEAST_DOCS, SCALE = 3, 1_000_000_000
#: Terms reported per source.
TOP = 200
#: Non-zero counts in a block of the reordered vocabulary.
CELLS = 1 << 17
#: Bytes of text that are counted at once, and counts that a worker adds up before it hands them on.
COUNT_BYTES, HELD = 1 << 20, 1 << 18

#: ASCII that is no part of a term (fixed by the contract): all but letters.
NO_TERM = bytes(b for b in range(128) if not chr(b).isalpha())
_CUTTER = Cutter(NO_TERM)


def count_block(block: pa.RecordBatch) -> pa.Table | None:
    """``lang, source, term, n, docs`` of a few texts (None without words)."""
    found = _CUTTER.cut(block.column(2))
    if not len(found.words):
        return None
    langs, sources = (block.column(c).dictionary_encode() for c in (0, 1))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    terms = found.words.dictionary_encode()
    wide, codes = len(terms.dictionary), terms.indices.to_numpy().astype(np.int64)
    keys, _, n = counted(group[found.row] * wide + codes)
    once, _, _ = counted(found.row * np.int64(wide) + codes)
    _, place, in_docs = counted(np.concatenate([keys, group[once // wide] * wide + once % wide]))
    group, code = keys // wide, keys % wide
    return pa.Table.from_arrays(
        [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))),
         terms.dictionary.take(pa.array(code)), pa.array(n, pa.int64()), pa.array(in_docs[place[:len(keys)]] - 1, pa.int64())],
        ["lang", "source", "term", "n", "docs"])


def count_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The counts of a batch, taken by block and added up before they leave the worker."""
    held, rows = [], 0

    def added() -> list[pa.RecordBatch]:
        whole = pa.concat_tables(held)
        if len(held) > 1:
            whole = whole.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            whole = whole.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])
        return whole.to_batches(max_chunksize=HELD)

    for part in blocks(batch, 2, COUNT_BYTES):
        counts = count_block(part)
        if counts is not None:
            held.append(counts)
            rows += counts.num_rows
        if rows >= HELD:
            yield from added()
            held, rows = [], 0
    if held:
        yield from added()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, docs, total, counts`` (array of source and n, ascending) of the kept terms.  ``docs``: ``lang, source, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from count_batch(batch)

    counts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    by_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.filter(F.col("docs") >= LEAST_DOCS)


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) by long division, exact for 0 < count + 1 <= total < 2^53."""
    whole, rest = F.expr("0L"), count + 1
    for _ in range(3):
        whole, rest = whole * 1000 + _div(rest * 1000, total), (rest * 1000) % total
    return whole + 1


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The same for an array."""
    whole, rest = np.zeros(len(counts), np.int64), counts.astype(np.int64) + 1
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language with the sum of f,
    part ``term`` the ``top`` terms that a source uses more than its language, with f against the language's share."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = cut(term_counts(named), "terms")
    cells = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    groups = named.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    groups = cut(groups, "groups")

    owned = cells.withColumnRenamed("total", "lang_count").join(groups, ["lang", "source"])
    rated = owned.select("lang", "source", "term", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_count"), F.col("lang_total")).alias("q"))
    value = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    terms = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    pairs = pair_sums(columns(kept), groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def columns(kept: DataFrame) -> DataFrame:
    """Run-length columns of the reordered vocabulary: ``lang, block, source, counts, ends``.

    A run holds the count that a source has in all terms up to its end; a block's last end is its number of terms
    (also held by a row of null source).  Sources without a term in a block have no row in it."""
    vectors = kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("terms"))
    ranged = vectors.repartitionByRange("lang", "counts").sortWithinPartitions("lang", "counts")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "lang", F.col("counts.source").alias("sources"), F.col("counts.n").alias("ns"), "terms")
    kind = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def block(lang: str, number: int, sources: pa.Array, vector: np.ndarray, ns: np.ndarray, terms: np.ndarray) -> pa.RecordBatch:
        rows = [{"lang": lang, "block": number, "source": None, "counts": [], "ends": [int(terms.sum())]}]
        coded = sources.dictionary_encode()
        ends, codes = np.cumsum(terms), coded.indices.to_numpy()
        by = np.argsort(codes, kind="stable")
        for k, mine in enumerate(np.split(by, np.searchsorted(codes[by], np.arange(1, len(coded.dictionary))))):
            column = np.zeros(len(terms), np.int64)
            column[vector[mine]] = ns[mine]
            last = np.flatnonzero(np.append(column[1:] != column[:-1], True))
            rows.append({"lang": lang, "block": number, "source": coded.dictionary[k].as_py(), "counts": column[last], "ends": ends[last]})
        return pa.RecordBatch.from_pylist(rows, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            langs = batch.column(1).to_pylist()
            edges = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)]
            for a, z in zip(edges, edges[1:]):
                cells = np.cumsum([0, *np.diff(batch.column(2).offsets.to_numpy())])[a:z + 1]
                cuts = [a, *[a + i for i in range(1, z - a) if (cells[i] - cells[0]) // CELLS != (cells[i - 1] - cells[0]) // CELLS], z]
                for s, e in zip(cuts, cuts[1:]):
                    if e > s:
                        part = batch.slice(s, e - s)
                        vector = np.repeat(np.arange(e - s), np.diff(cells[s - a:e - a + 1]))
                        yield block(langs[s], part.column(0)[0].as_py() << 32 | number, part.column(2).flatten(), vector,
                                    part.column(3).flatten().to_numpy(), part.column(4).to_numpy())
                        number += 1

    return cut(ranged.mapInArrow(run, "lang string, block long, source string, counts array<long>, ends array<long>"), "run-length-columns")


def pair_sums(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, other, value``: sums of f over all kept terms for every ordered pair of sources of a language."""
    sizes = runs.filter("source IS NULL").select("lang", "block", F.col("ends")[0].alias("terms"))
    # a language without kept terms has one block of no terms
    spread = groups.join(sizes, "lang", "left").select("lang", "source", "total", F.coalesce("block", F.lit(-1)).alias("block"), F.coalesce("terms", F.lit(0)).alias("terms"))
    met = spread.join(runs.filter("source IS NOT NULL"), ["lang", "block", "source"], "left")
    met = met.select("lang", "block", "source", "total", "terms", "counts", "ends")
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("value", pa.int64())])

    def block(table: pa.Table) -> pa.Table:
        lang, terms = table["lang"][0].as_py(), table["terms"][0].as_py()
        names, held = table["source"].to_pylist(), []
        for total, counts, ends in zip(table["total"].to_pylist(), table["counts"], table["ends"]):
            if terms == 0:
                held.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            elif not counts.is_valid:
                held.append((shares(np.zeros(1, np.int64), total), np.array([terms])))
            else:
                held.append((shares(counts.values.to_numpy(), total), ends.values.to_numpy()))
        out = defaultdict(list)
        for i in range(len(names)):
            for j in range(i):
                (p, ends_p), (q, ends_q) = held[i], held[j]
                ends = np.union1d(ends_p, ends_q)
                lengths = np.diff(ends, prepend=0)
                p, q = p[np.searchsorted(ends_p, ends)], q[np.searchsorted(ends_q, ends)]
                apart = (p - q) ** 2
                for x, y, by in ((i, j, q), (j, i, p)):
                    out["source"].append(names[x])
                    out["other"].append(names[y])
                    out["value"].append(int((apart // by * lengths).sum()))
        return pa.table({"lang": [lang] * len(out["value"]), **{c: out[c] for c in ("source", "other", "value")}}, kind)

    sums = met.groupBy("lang", "block").applyInArrow(block, "lang string, source string, other string, value long")
    return sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))

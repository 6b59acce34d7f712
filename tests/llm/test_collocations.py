"""Collocations against a count of all phrases in plain Python."""
import random
import re
from collections import Counter

import pytest

from sluice.llm import collocations as co
from sluice.llm import words as words_module

UP = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, support, longest=5, covered=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    often = {k: v for k, v in f.items() if v >= support}
    out = []
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        inside = any(x == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (x, q), b in often.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), len(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


def of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "phrase", "words", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = ["a", "b", "C", "d'", "é", "f-1", "日本", "\x00g"] + [f"rare{i}" for i in range(40)]
    made = []
    for _ in range(250):
        text = "".join(rng.choice(vocabulary[:rng.choice([4, 8, 48])]) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(rng.randint(0, 60)))
        made.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    # a passage that many rows share, repeated rows, and overlapping phrases
    made += [("en", "terms of use may apply here today")] * 40 + [("de", "x x x x x x")] * 9
    return made + [("en", None), ("en", ""), (None, " \n\t,"), ("fr", "une fois")]


def frame_of(spark, rows, parts=4):
    return spark.createDataFrame(rows, "lang string, text string").repartition(parts)


@pytest.mark.parametrize("support, covered", [(12, 100), (5, 80), (1, 100)])
def test_all_phrases(spark, rows, support, covered):
    some = rows if support > 1 else rows[:20]
    assert of(co.collocations(frame_of(spark, some), covered=covered, support=support)) == by_hand(some, support, covered=covered)


def test_small_shards_and_bounded_broadcasts_change_nothing(spark, rows, monkeypatch):
    want = by_hand(rows, 12)
    assert of(co.collocations(frame_of(spark, rows), support=12, words_limit=3, candidates_limit=20)) == want
    small = co.mined(frame_of(spark, rows).fillna("und", ["lang"]), None, {lang: 10_000 for lang in ("en", "de", "und", "fr")}, 12, 5)
    assert small.filter("phrase IS NULL").count() > 4
    monkeypatch.setattr(words_module, "BLOCK_BYTES", 300)
    from sluice.llm.words import blocks
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * len(rows), "text": [t for _, t in rows]})
    parts = list(blocks(batch, 1))
    assert sum(p.num_rows for p in parts) == len(rows) and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 300 for p in parts)


def test_lowered_support_misses_nothing_and_remainders_bound_the_rest(spark, rows):
    docs = frame_of(spark, rows, 6).fillna("und", ["lang"])
    totals = {r["lang"]: r["n"] for r in co.word_counts(docs).groupBy("lang").agg({"n": "sum"}).toDF("lang", "n").collect()}
    shards = co.mined(docs, None, totals, 12, 5).collect()
    reported, slack, everywhere = Counter(), Counter(), Counter()
    for r in shards:
        if r["phrase"] is None:
            everywhere[r["lang"]] += r["slack"]
        else:
            reported[r["lang"], r["phrase"]] += r["n"]
            slack[r["lang"], r["phrase"]] += r["slack"]
    found, _ = co.phrases(frame_of(spark, rows), support=12)
    exact = {(r["lang"], r["phrase"]): r["n"] for r in found.filter("phrase LIKE '% %'").collect()}
    assert max(len(p.split(" ")) for _, p in exact) == 5
    assert exact and all(k in reported and reported[k] <= n <= reported[k] + everywhere[k[0]] - slack[k] for k, n in exact.items())


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(10 ** 13, 2 * 10 ** 16, 10 ** 13 + 7, 3 * 10 ** 14)], "a long, n long, l long, r long")
    assert big.select(co.score("a", "n", "l", "r")).first()[0] == 1000 * 10 ** 13 * 2 * 10 ** 16 // ((10 ** 13 + 7) * 3 * 10 ** 14)


def test_ranks_and_odd_rows(spark, rows, odd_docs, no_docs):
    found = co.ranked(co.collocations(frame_of(spark, rows), support=12), top=6)
    want = []
    for lang in {r[0] for r in by_hand(rows, 12)}:
        mine = sorted((r for r in by_hand(rows, 12) if r[0] == lang), key=lambda r: (-r[7], -r[3], r[1].encode()))
        want += [(lang, i, r[1]) for i, r in enumerate(mine[:6], 1)]
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in found.collect()) == sorted(want)
    odd = [tuple(r) for r in odd_docs.select("lang", "text").collect()]
    assert of(co.collocations(odd_docs)) == by_hand(odd, 100)
    assert co.collocations(no_docs).count() == 0

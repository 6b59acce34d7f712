"""Source divergence against sums over the whole vocabulary."""
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, top=200):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(UP)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, total, groups = Counter(), Counter(), defaultdict(Counter)
        for _, source, c in (d for d in docs if d[0] == lang):
            df.update(c.keys())
            total.update(c)
            groups[source].update(c)
        kept = sorted(t for t in df if df[t] >= 3)
        p_of = lambda c: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: p_of(c) for s, c in groups.items()}
        q = p_of(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            terms = sorted(((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]))[:top]
            out += [(lang, s, part, x[2], -x[0], i) for part, xs in (("pair", pairs), ("term", terms)) for i, x in enumerate(xs, 1)]
    return sorted(out)


def of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)] + ["Élan", "日本", "ZED", "zed"]
    out = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "b", "c", "", None, "é"])
        shift = hash_of(source)
        out.append((lang, source, "".join(vocabulary[int(rng.paretovariate(0.6) + shift) % len(vocabulary)] + rng.choice([" ", "1", "-", "\n"]) for _ in range(rng.randint(0, 40)))))
    return out + [("xx", "lonely", "one two"), ("yy", "s", None), ("yy", "t", ""), ("zz", "s", "a a a a"), ("zz", "t", "a"), ("zz", "t", "a b"), ("zz", "u", "12 3")]


def hash_of(source):
    return sum((source or "").encode()) % 7


def test_sums_and_terms(spark, rows):
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert of(dv.audit(frame)) == by_hand(rows)
    assert of(dv.audit(frame, top=5)) == by_hand(rows, 5)


def test_small_blocks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(dv, "CELLS", 7)
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    kept = dv.term_counts(frame.fillna(""))
    blocks = dv.columns(kept)
    sizes = blocks.filter("source IS NULL").groupBy("lang").agg({"block": "count"}).collect()
    assert max(r[1] for r in sizes) > 3
    # runs end where the block does, and neighbouring runs differ
    for r in blocks.join(blocks.filter("source IS NULL").selectExpr("lang", "block", "ends[0] AS n"), ["lang", "block"]).filter("source IS NOT NULL").collect():
        assert r["ends"][-1] == r["n"] and all(a != b for a, b in zip(r["counts"], r["counts"][1:])) and r["ends"] == sorted(set(r["ends"]))
    assert of(dv.audit(frame)) == by_hand(rows)


def test_shares_are_exact(spark):
    cases = [(c, t) for c in (0, 1, 9_223_372_037, 10 ** 13, 2 ** 52) for t in (1, 7, 10 ** 13 + 1, 2 ** 53 - 1) if c + 1 <= t]
    frame = spark.createDataFrame(cases, "c long, t long")
    want = [1 + 10 ** 9 * (c + 1) // t for c, t in cases]
    assert [r[0] for r in frame.select(dv.share(frame.c, frame.t)).collect()] == want
    assert [int(dv.shares(np.array([c]), t)[0]) for c, t in cases] == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    assert of(dv.audit(odd_docs)) == by_hand(rows)
    assert dv.audit(no_docs).count() == 0


def test_blocks_are_small_and_their_counts_are_added_up(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("w" + "abcdefghij"[rng.randrange(10)] * rng.randint(1, 90) for _ in range(200)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 500, "source": ["a", "b", "c", "d"] * 250, "text": texts})
    tracemalloc.start()
    small = pa.Table.from_batches(dv.count_batch(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    keys = list(zip(*(small[c].to_pylist() for c in ("lang", "source", "term"))))
    assert len(keys) == len(set(keys))
    monkeypatch.setattr(dv, "COUNT_BYTES", 1 << 30)
    whole = pa.Table.from_batches(dv.count_batch(batch))
    assert sorted(map(str, small.to_pylist())) == sorted(map(str, whole.to_pylist()))

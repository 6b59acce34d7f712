"""Decontamination against a search by plain Python, and its removals."""
import hashlib
import random
import re

import pytest

from sluice.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UP))


def by_hand(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (who := windows.get(tuple(w[i:i + k]))):
                    hit |= set(range(i, i + k))
                    found |= who
        out.append((doc_id, len(w), len(hit), sorted(found, key=str.encode)))
    return sorted(out, key=repr)


def of(frame):
    rows = frame.withColumn("hit", dc.n_hit()).select("doc_id", "__n_words", "hit", "__items").collect()
    return sorted(((r[0], r[1], r[2], r[3]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "é1", "x9", "日本", "z"]
    line = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x00", "_"]) for _ in range(k))
    items = [(i, line(rng.randint(1, 25))) for i in range(60)] + [(7, "one two three"), (None, "only here " * 6), (100, None), (101, ""), (102, "..."), (103, "z z z z z z z z z z z z")]
    docs = [(i, line(rng.randint(0, 120))) for i in range(80)]
    docs += [(200 + k, line(5) + (text or "") + line(4)) for k, (_, text) in enumerate(items)]
    docs += [(300, None), (301, ""), (302, " \n.."), (None, "one TWO, three"), (303, "z " * 40), (303, "z " * 40), (304, "only here " * 30)]
    return docs, items


def frames(spark, made):
    docs, items = made
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_hits_are_those_of_a_plain_search(spark, made):
    docs, items = frames(spark, made)
    assert of(dc.find(docs, items)) == by_hand(*made)


def test_blocks_of_test_words_and_segments_change_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(dc, "SEGMENT", 4)
    docs, items = frames(spark, made)
    monkeypatch.setattr(dc, "SCANS", 2)
    assert of(dc.find(docs, items, block_bytes=1500)) == by_hand(*made)


def test_equal_hashes_are_told_apart(spark, made, monkeypatch):
    import numpy as np
    plain = dc.Windows.of(frames(spark, made)[1].selectExpr("coalesce(cast(item_id AS string), '') AS item", "coalesce(text, '') AS words").toArrow(), 10)
    monkeypatch.setattr(dc, "_hashes", lambda grid: np.zeros(len(grid), np.uint64))
    flat = dc.Windows.of(frames(spark, made)[1].selectExpr("coalesce(cast(item_id AS string), '') AS item", "coalesce(text, '') AS words").toArrow(), 10)
    import pyarrow as pa
    found = dc._CUTTER.cut(pa.array([t for _, t in made[0]], pa.string()))
    a = flat.hits(found)
    monkeypatch.undo()
    b = plain.hits(found)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_documents_and_spans_go(spark, made):
    docs, items = frames(spark, made)
    dirty = {r[0] for r in by_hand(*made) if r[2]}
    left = {r["doc_id"] for r in dc.remove_documents(docs, items).collect()}
    assert left == {d for d, _ in made[0]} - dirty
    ten = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "Start: é A b,c d e f g h i J K. End"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in dc.remove_spans(texts, ten).collect()} == {1: "Start: é . End", 2: "a b c", 3: None}


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = odd_docs.select("doc_id", "text").collect()
    found = dc.find(odd_docs, items)
    assert set(odd_docs.columns) < set(found.columns)
    assert of(found) == by_hand([tuple(r) for r in rows], [(1, items.first()["text"])])
    assert dc.find(no_docs, items).count() == 0
    assert {r["__n_words"] > 0 and bool(r["__runs"]) for r in dc.find(odd_docs, items.limit(0)).collect()} == {False}
    again = dc.find(found.withColumn("__items", found["doc_id"]), items)
    assert of(again) == of(found)


def test_digest_of_no_items_is_that_of_the_empty_text(spark):
    from sluice.llm.queries import QUERIES
    from tests.conftest import SF001
    rows = QUERIES["op13_decontamination"](spark, SF001).collect()
    clean = [r for r in rows if not r["contaminated"]]
    assert clean and {r["items_sha256"] for r in clean} == {hashlib.sha256(b"").hexdigest()}

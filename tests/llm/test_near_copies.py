"""Order MinHash classes against an alignment of all pairs that share a run of words."""
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import order_minhash as omh
from sluice.llm.components import components
from tests.conftest import SF001


def plain_matched(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def codes_of(words):
    return omh.word_codes(omh.word_hashes(pa.array([" ".join(words)]))[0])


def name_of(text):
    return next(omh.coded_rows(pa.array([text])))[0]


def linked(texts):
    """Pairs of texts with an aligned similarity from 0.8 on, among all pairs that share a run of five words,
    and those of them of which two thirds of the runs are shared."""
    codes = {t: codes_of(t.split()) for t in texts if not t.startswith("\0")}
    runs = {t: Counter(omh.kmers(c).tolist()) for t, c in codes.items()}
    holders, shared = defaultdict(list), Counter()
    for t, r in runs.items():
        for h in r:
            holders[h].append(t)
    for group in holders.values():
        shared.update((min(a, b), max(a, b)) for i, a in enumerate(group) for b in group[:i])
    every, close = [], []
    for (a, b), n in shared.items():
        both = sum((runs[a] & runs[b]).values())
        least = both / (sum(runs[a].values()) + sum(runs[b].values()) - both)
        if least > 0.2 and omh.similar(codes[a], codes[b]):
            every.append((a, b))
            if least >= 0.66:
                close.append((a, b))
    return every, close


def named(rows, links, texts):
    root, of = roots(texts, links), {}
    for t, ids in texts.items():
        of.setdefault(root[t], []).extend(x for x in ids if x is not None)
    return Counter((i, min(of[root[t]], default=None)) for t, ids in texts.items() for i in ids)


def by_text(rows):
    texts = defaultdict(list)
    for i, t in rows:
        texts[" ".join(omh.words_of(t)) or "\0" + (t or "")].append(i)
    return texts


def brute(rows):
    """Class id of every row, by the alignment of all pairs."""
    texts = by_text(rows)
    return named(rows, linked(texts)[0], texts)


def plain_similar(a, b):
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    m = plain_matched(a.tolist(), b.tolist())
    return m >= 0.8 * (len(a) + len(b) - m) - 1e-9


def found(frame):
    return Counter((r.doc_id, r.class_id) for r in omh.classes(frame).collect())


def test_banded_alignment_decides_like_the_full_one():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() < 0.93]
        b = [rng.randint(0, 6) if rng.random() < 0.07 else x for x in b]
        a, b = np.array(a, np.uint32), np.array(b, np.uint32)
        assert omh.matched(a, b, 100) == plain_matched(a.tolist(), b.tolist())
        if len(a) + len(b):
            assert omh.similar(a, b) == plain_similar(a, b)


def test_sketches_see_the_order():
    a = np.arange(200, dtype=np.uint32)
    blocks = np.concatenate([a[100:], a[:100]])
    same = [(omh.sketch(a) == omh.sketch(x)).mean() for x in (a, blocks)]
    jaccard = 192 / 200
    assert same[0] == 1 and same[1] < 0.7 * jaccard ** omh.PICK


def test_planted_copies(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    rows, passage = [], text(56)
    for _ in range(12):  # groups of exact and near copies
        base = text(rng.randint(60, 400))
        rows += [" ".join(base)] * rng.randint(1, 4)
        rows += [" ".join(rng.choice(vocabulary) if rng.random() < 0.03 else w for w in base) for _ in range(rng.randint(0, 5))]
    big = text(150)
    rows += [" ".join(rng.choice(vocabulary) if rng.random() < 0.04 else w for w in big) for _ in range(300)]
    rows += [" ".join(text(120) + passage + text(60)) for _ in range(60)]
    rows += ["", " ", None, "short", "Short!", "a b c", LONG := " ".join(text(30_000)), LONG + " end"]
    rows = list(enumerate(rows)) + [(None, "a b c"), (None, None), (3, rows[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    texts = by_text(rows)
    every, close = linked(texts)
    classes = omh.classes(frame).collect()
    node = {name_of(t.removeprefix("\0")): t for t in texts}
    head = {node[r.node]: r.class_node for r in classes}
    assert Counter(r.doc_id for r in classes) == Counter(i for i, _ in rows)
    assert all(head[a] == head[b] for a, b in close), "no link of texts that share two thirds of their runs is lost"
    root = roots(texts, every)
    assert all(root[t] == root[node[head[t]]] for t in texts), "no class joins what is not linked"


def edited(words, every, kind, rng):
    """``words`` with one in ``every`` replaced (evenly or at random) or left out."""
    at = set(range(every // 2, len(words), every)) if kind == "even" else set(rng.sample(range(len(words)), len(words) // every))
    return [f"new{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(words) if kind != "less" or i not in at]


def test_pairs_at_the_threshold(spark):
    """Pairs without a third copy, of an aligned similarity of 0.80 to 0.85, from five words on."""
    rng, rows, pairs = random.Random(3), [], []
    vocabulary = [f"w{i}" for i in range(3000)]
    for n, every, kind in [(5, 5, "less"), (6, 6, "less"), (9, 9, "even"), (10, 10, "random"), (13, 11, "random"), (16, 13, "even"), (17, 9, "random"),
                           *((n, every, kind) for n in (20, 21, 60, 300, 1500) for every, kind in ((9, "even"), (9, "random"), (10, "random"), (5, "less")))]:
        for _ in range(8):
            base = [rng.choice(vocabulary) for _ in range(n)]
            copy = edited(base, every, kind, rng)
            if omh.similar(codes_of(base), codes_of(copy)):
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    assert len(pairs) >= 200
    kind = {r.doc_id: r.class_id for r in omh.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    lost = [(a, len(rows[a][1].split())) for a, b in pairs if kind[a] != kind[b]]
    assert not lost


def test_marks_leave_no_copy_out():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randint(0, 40) for _ in range(rng.randint(1, 200))]
        b = edited(a, rng.choice([5, 9, 12, 40]), rng.choice(["random", "less"]), rng)
        x, y = codes_of(map(str, a)), codes_of(map(str, b))
        places = sum(int(v).bit_count() for v in (omh.mark(omh.labelled(omh.kmers(x, 1))) ^ omh.mark(omh.labelled(omh.kmers(y, 1)))).view(np.uint64))
        assert places <= len(x) + len(y) - 2 * plain_matched(x.tolist(), y.tolist())


def test_documents(spark):
    frame = spark.read.parquet(f"{SF001}/documents.parquet")
    assert found(frame) == brute([(r.doc_id, r.text) for r in frame.collect()])


def test_one_of_each_class_stays(spark, odd_docs, no_docs):
    kept = omh.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # null and empty texts are equal, a blank one is none of them; row 5 stands for its copies
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7]
    clash = odd_docs.withColumnRenamed("n_chars", "__name").withColumnRenamed("rank", "__id")
    assert omh.keep_one(clash).columns == clash.columns and omh.keep_one(clash).count() == 6
    assert omh.keep_one(no_docs).count() == 0 and omh.classes(no_docs).count() == 0


def test_null_ids_come_last_and_wordless_texts_stand_alone(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (5, base + " more"), (9, base), (1, "!!!"), (2, "$$$"), (3, "!!!"), (4, "\U0001f642"), (None, "alone")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == Counter([(None, 5), (5, 5), (9, 5), (1, 1), (2, 2), (3, 1), (4, 4), (None, None)])


def test_words_are_those_of_the_pattern():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB_1 é\u0301Ωß.-\n\u2014日本\u0130\U0001f642²") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    hashes, sizes = omh.word_hashes(pa.array(texts, pa.string()))
    every = [w for t in texts for w in omh.words_of(t)]
    assert sizes.tolist() == [len(omh.words_of(t)) for t in texts]
    name = {}
    assert all(name.setdefault(h, w) == w for h, w in zip(hashes.tolist(), every)) and len(name) == len(set(every))


def test_least_values():
    rng = np.random.default_rng(0)
    for n in (8, 50, 200, 3000):
        order = rng.integers(0, 1 << 64, (64, n), dtype=np.uint64)
        order[3] |= np.uint64(1 << 63)  # a row with too few small values
        for pick in (4, 7):
            got = np.sort(omh.least(order, pick), axis=1)
            assert (got == np.sort(np.argsort(order, axis=1)[:, :pick], axis=1)).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(60)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_meet_their_leader_in_few_buckets(spark, monkeypatch):
    rng, rows = random.Random(4), []
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    for i in range(200):
        rows.append((i, " ".join(f"new{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in base)))
    met, confirm = [], omh.confirm
    monkeypatch.setattr(omh, "confirm", lambda pairs, texts: met.append(pairs.count()) or confirm(pairs, texts))
    classes = {r.class_id for r in omh.classes(spark.createDataFrame([*rows, (200, " ".join(base))], "doc_id long, text string").repartition(4)).collect()}
    assert classes == {0} and sum(met) < 16 * len(rows)


def peak_mb(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_workers_hold_little():
    assert peak_mb(omh.Characters) < 20
    assert peak_mb(lambda: omh.sketch(np.arange(100_000, dtype=np.uint32))) < 30


def test_texts_just_too_far_apart_are_not_aligned(spark, monkeypatch):
    """Long texts of one template, pairwise at 0.71: they share buckets, but marks leave nearly all pairs out, and lengths and marks
    are joined to a bucket's members twice at most."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(750)]
    rows = [(i, " ".join(f"new{rng.randrange(10**6)}" if rng.random() < 0.087 else w for w in base)) for i in range(60)]
    met, written, confirm, cut = [], [], omh.confirm, omh.cut
    monkeypatch.setattr(omh, "confirm", lambda pairs, texts: met.append(pairs.distinct().count()) or confirm(pairs, texts))
    monkeypatch.setattr(omh, "cut", lambda df, name: written.append(name) or cut(df, name))
    classes = {(r.doc_id, r.class_id) for r in omh.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert classes == set(brute(rows))
    assert len(met) > 1 and sum(met) < 200 and written.count("omh-rows") <= 2

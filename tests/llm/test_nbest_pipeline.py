"""N-best segmentation against all segmentations, and the pipeline's stages."""
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from sluice.llm import nbest, packing
from sluice.llm.encoding import encoder
from sluice.llm.words import blocks
from tests.conftest import SF001
from tests.llm.test_near_copies import brute, peak_mb

PIECES = "piece_bpe_32k.model"


class Small(nbest.Model):
    """A model of few pieces, without normalisation beyond spaces."""

    def __init__(self, pieces):
        self.set_up({p: (s, i) for i, (p, s) in enumerate(pieces)}, {b: 1000 + b for b in range(256)})

    def normalize(self, text):
        return nbest.SPACE + text.replace(" ", nbest.SPACE) if text else ""


def every(m, text, n):
    x, out = m.normalize(text), []

    def go(at, ids, score):
        if at == len(x):
            out.append((-score, ids[::-1], ids))
            return
        for end in range(at + 1, min(len(x), at + m.longest) + 1):
            if found := m.pieces.get(x[at:end]):
                go(end, ids + (found[1],), score + found[0])
        if x[at] not in m.pieces:
            go(at + 1, ids + m.uncovered(x[at]), score + m.lowest)
    go(0, (), 0)
    return [(-s, ids) for s, _, ids in sorted(out)[:n]]


@pytest.mark.parametrize("start", range(0, 1500, 300))
def test_best_of_all_segmentations_with_ties(start):
    for seed in range(start, start + 300):
        rng = random.Random(seed)
        vocabulary = [nbest.SPACE, nbest.SPACE * 2] * (rng.random() < 0.8) + list("ab"[:rng.randint(1, 2)])
        vocabulary += [(nbest.SPACE if rng.random() < 0.4 else "") + "".join(rng.choice("ab.") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 7))]
        vocabulary = list(dict.fromkeys(vocabulary))
        rng.shuffle(vocabulary)
        m = Small([(v, -rng.randint(0, 3 if seed % 2 else 30)) for v in vocabulary])
        text = "".join(rng.choice("aab.b\n,c" if seed % 3 else "aab ") for _ in range(rng.randint(0, 9)))
        n = rng.randint(1, 6)
        assert [(s, tuple(i for p in parts for i in p)) for s, parts in m.nbest(text, n)] == every(m, text, n), (seed, text)


def test_encode_and_decode(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(40).select("doc_id", "text")
    path = public_tokenizers.path(PIECES)
    rows = nbest.decode_ids(nbest.encode_nbest(docs, path, 3), path).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.decoded == texts[r.doc_id] and r.text_crc32 == zlib.crc32(r.decoded.encode())
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
    m = nbest.model(path)
    score = {i: s for s, i in m.pieces.values()}
    for doc in texts:
        mine = sorted((r.rank, r.score, tuple(r.ids)) for r in rows if r.doc_id == doc)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and len({x[2] for x in mine}) == len(mine)
        assert [x[1] for x in mine] == sorted((x[1] for x in mine), reverse=True)
        for _, total, ids in mine:
            if all(i in score for i in ids):
                assert total == sum(score[i] for i in ids) / nbest.UNIT
    odd = nbest.encode_nbest(odd_docs, path, 2).filter("rank = 1")
    assert odd.count() == odd_docs.count() and {r.n_pieces for r in odd.collect() if r.doc_id in (1, 2)} == {0}
    assert nbest.encode_nbest(no_docs, path, 2).count() == 0


def test_long_text_of_one_word():
    m = Small([("a", -5), ("ab", -1), ("b", -5), ("ba", -1)])
    found = m.nbest("ab" * 20_000, 4)
    assert len(found) == 4 and found[0][0] >= found[3][0]


def stages(spark, docs, sf_dir):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.shared.cut(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return out


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF001, "documents")
    rules, classifier, copies, packed = stages(spark, docs, SF001)
    assert all(d.columns == docs.columns for d in (rules, classifier, copies))
    assert 0 < packed.count() and copies.count() < classifier.count() <= rules.count() < docs.count()
    left = [(r.doc_id, r.text) for r in classifier.collect()]
    heads = {c for _, c in brute(left)}
    assert sorted(r.doc_id for r in copies.collect()) == sorted(heads)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == heads
    labels = {r.doc_id: r.quality for r in corpus_pipeline.table(spark, SF001, "labels").collect()}
    good = [i for i, q in labels.items() if q]
    stay = {r.doc_id for r in classifier.collect()}
    assert np.mean([i in stay for i in good]) > 0.9


def test_stages_on_odd_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        out = stages(spark, docs, SF001)
        assert all(d.columns == docs.columns for d in out[:3])
    assert corpus_pipeline.drop_copies(spark, odd_docs, SF001).columns == odd_docs.columns


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF001)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("seed", range(40))
def test_one_pass_over_many_words_is_the_pass_over_each(seed):
    """Scores, ids and leads with ties, pieces of every length, and characters that no piece covers."""
    rng = random.Random(seed)
    vocabulary = list(dict.fromkeys(list("abc") + ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]))
    rng.shuffle(vocabulary)
    pieces = [(v, -rng.randint(0, 4)) for v in vocabulary]
    words = {"".join(rng.choice("abcabcabcé雨") for _ in range(rng.randint(1, 40))) for _ in range(60)}
    many, each = Small(pieces), Small(pieces)
    many.learn(words)
    learnt = dict(many.fresh)
    assert set(learnt) == {w for w in words if len(w) <= nbest.LONGEST and all(c in each.pieces for c in w)}
    assert all(learnt[w] == each.word(w) for w in learnt)
    assert [many.word(w) for w in sorted(words)] == [each.word(w) for w in sorted(words)]


def test_packed_words_are_those_of_the_whole_text(monkeypatch):
    """Ids and texts put together from words are those of a whole segmentation, and no word is decoded for each of them."""
    m = nbest.model(public_tokenizers.path("piece_bpe_32k.model"))
    text = "Some plain words, some words again \U0001f642 and a\nlast line.  Two  spaces\x00 日本語 " * 40
    decoded, raw = [], m.raw
    monkeypatch.setattr(m, "raw", lambda ids: decoded.append(ids) or raw(ids))
    words = m.words_of(text)
    got = list(m.encoded(words, 4))
    assert len(got) == 4 and len(decoded) < len(words)
    for (score, ids, crc), (want, parts) in zip(got, m.nbest_words(words, 4), strict=True):
        flat = [i for part in parts for i in part]
        assert score == want and np.frombuffer(ids, "<u4").tolist() == flat
        assert crc == zlib.crc32(m.decode(flat).encode("utf-8", "surrogatepass"))


@pytest.mark.parametrize("seed", range(40))
def test_search_up_to_a_loss(seed):
    """A search that is told the largest loss that matters gives the beginning of the whole search, and goes no farther."""
    rng = random.Random(seed)
    pieces = list(dict.fromkeys(list("ab") + ["".join(rng.choice("ab") for _ in range(rng.randint(2, 3))) for _ in range(5)]))
    m = Small([(p, -rng.randint(0, 6)) for p in pieces])
    word = "".join(rng.choice("aabbc") for _ in range(rng.randint(1, 9)))
    whole = m.search(word, 6, float("inf"))
    for limit in range(8):
        assert m.search(word, 6, limit) == [s for s in whole if whole[0].score - s.score <= limit]
        for reach in (limit, float("inf"), limit):  # what is kept serves smaller losses
            assert {x[3] for x in m.choices(word, 6, reach)} >= {s.ids for s in whole if whole[0].score - s.score <= reach}


def test_best_segmentations_need_no_call_for_each_word():
    """New words get one pass and are put together by array: a text of 20,000 different words takes fewer calls."""
    m = nbest.model(public_tokenizers.path(PIECES))
    rng = random.Random(8)
    words = m.words_of(" ".join(dict.fromkeys("".join(rng.choice("aeinorst") for _ in range(rng.randint(6, 12))) for _ in range(20_000))))
    list(m.encoded(m.words_of("of some words"), 1))  # tables and imports of a first use
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        (score, ids, crc), = m.encoded(words, 1)
    finally:
        sys.setprofile(None)
    assert len(words) > 19_000 and len(calls) < len(words)
    (want, parts), = m.nbest_words(words, 1)
    assert score == want and np.frombuffer(ids, "<u4").tolist() == [i for part in parts for i in part]
    assert crc == zlib.crc32("".join(words).replace(nbest.SPACE, " ")[1:].encode())


@pytest.mark.parametrize("seed", range(60))
def test_many_texts_are_encoded_as_each(seed, monkeypatch):
    """Ties, words that are forgotten in between, long words, empty texts, and characters that no piece or byte covers."""
    monkeypatch.setattr(nbest, "KEPT", 6)
    monkeypatch.setattr(nbest, "COMMON", 1 + seed % 3)
    monkeypatch.setattr(nbest, "PASS", 1 + seed % 4)
    rng = random.Random(seed)
    pieces = list(dict.fromkeys([nbest.SPACE, *"abé", *("".join(rng.choice("abé.") for _ in range(rng.randint(2, 3))) for _ in range(5))]))
    m = Small([(p, -rng.randint(0, 5)) for p in pieces])
    m.byte_ids = {b: i for b, i in m.byte_ids.items() if b < 200 or seed % 2}
    for _ in range(4):
        texts = ["".join(rng.choice("aabé. \n雨c") for _ in range(rng.randint(0, 8))) for _ in range(5)] + ["", "ab" * 20]
        n = rng.randint(1, 5)
        for text, found in zip(texts, m.encoded_many([m.words_of(t) for t in texts], n), strict=True):
            got = [(s, tuple(np.frombuffer(ids, "<u4").tolist())) for s, ids, _ in found]
            if len(text) < 10:
                assert got == every(m, text, n), (seed, text)
            assert [crc for _, _, crc in found] == [zlib.crc32(m.decode(ids).encode()) for _, ids in got]
    assert len(m.row) <= 6 + len(texts) * 8


def test_packing_workers_hold_little():
    """8 MB of text are not encoded at once."""
    text = " ".join(f"w{i % 997} of some plain words" for i in range(40))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * (8_000_000 // len(text)))], ["text"])
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert peak_mb(lambda: [encode.closed(part.column(0), 1)[0].sum() for part in blocks(batch, 0, packing.ENCODE_BYTES)]) < 80

"""Token files and packing against the tokenizers library itself."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing, shared, token_files
from sluice.llm.encoding import Encoder
from tests.conftest import SF001

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
SPACES = ["a  b", "a   b", " a", "a ", "a \n b", "a\n\nb", "a\n b", " \n b", "\n", "  ", "don't  'll", "x\t y", "á ́b", "AΣ ΣaΣ.",
          "<|endoftext|> a<|endoftext|>", "a\x1c b", "\x1fb  c", "日本 語", "a  b", "  a  \n\n  b ", " a\nb \nc", "İ I", "ab\n", "\nab", "it's we'LL", "1234 5,6", "\U0001f642 x"]


def ids_of(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids + [end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_cached_chunks_give_the_library_ids(spark, name):
    encoder = Encoder(public_tokenizers.path(name))
    rng = random.Random(3)
    mixed = ["".join(rng.choice(" \n\tabcde.,'1é") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts = SPACES + mixed + [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(60).collect()]
    for _ in range(2):  # fresh, then cached
        for text, want in zip(texts, ids_of(name, texts, 0)):
            assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == want[:-1].tolist(), repr(text[:80])


def by_hand(rows):
    texts = sorted(((r.doc_id is not None, r.doc_id or 0), r.text is not None, zlib.crc32((r.text or "").encode()), r.text or "", r.doc_id) for r in rows)
    at, out = 0, []
    for ids, t in zip(ids_of(BYTES, [t[3] for t in texts], 0), texts):
        out.append((t[4], at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def read_back(spark, docs):
    target = shared.folder(spark, "test-tokens")
    parts = token_files.write_token_files(docs, target, public_tokenizers.path(BYTES), 0)
    return parts, sorted((tuple(r) for r in token_files.read_token_files(spark, target).collect()), key=lambda r: r[1])


def test_files_round_trip(spark, odd_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert read_back(spark, docs.repartition(5))[1] == by_hand(docs.collect())
    assert read_back(spark, odd_docs)[1] == by_hand(odd_docs.collect())


def test_many_parts_keep_the_order(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts, rows = read_back(spark, docs)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1 and rows == by_hand(docs.collect())


def test_no_documents(spark, no_docs):
    assert read_back(spark, no_docs) == ([], [])
    assert packing.pack(no_docs, public_tokenizers.path(WORDS), 1).count() == 0


def test_first_fit_decreasing_is_the_plain_rule():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            at = next((i for i, r in enumerate(room) if r >= s), len(room))
            if at == len(room):
                room.append(20)
            want.append((at, 20 - room[at]))
            room[at] -= s
        assert list(zip(*packing.first_fit_decreasing(sizes, 20))) == want


@pytest.mark.parametrize("group", [4096, 16])
def test_packing_covers_every_id_once(spark, odd_docs, group):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text").filter("doc_id is null or doc_id not in (5)"))
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, public_tokenizers.path(WORDS), 1, group_docs=group).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, ids_of(WORDS, list(texts.values()), 1)))
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length])
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen.keys() == ids.keys()
    for doc, pieces in seen.items():
        assert sum(p[1] for p in pieces) == len(ids[doc]) and all(a[0] + a[1] == b[0] for a, b in zip(sorted(pieces), sorted(pieces)[1:]))
    for pieces in sequences.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and sum(pieces[-1]) <= 2048
    if group == 4096:
        assert sum(map(len, ids.values())) > 0.98 * 2048 * (len(sequences) - 1)


def test_packing_repeated_rows(spark, odd_docs):
    rows = packing.pack(odd_docs, public_tokenizers.path(WORDS), 1).collect()
    assert sum(r.length for r in rows) == sum(len(x) for x in ids_of(WORDS, [r.text for r in odd_docs.collect()], 1))

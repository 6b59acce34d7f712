"""Jump sharding and exact top-k against brute force."""
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import exact_topk, jump_sharding
from sluice.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001


def jump(key, shards):
    """The published algorithm, one key at a time."""
    key, b, j = key % 2 ** 64, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2 ** 64
        j = math.floor((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_hash():
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, *range(2, 300)]
    for shards in (1, 2, 8, 9, 1000):
        assert jump_sharding.jump(np.array(keys, np.int64).view(np.uint64), shards).tolist() == [jump(k, shards) for k in keys]


def test_one_more_shard_takes_only_into_itself():
    keys = np.arange(20_000, dtype=np.uint64)
    for n in (1, 4, 8):
        old, new = jump_sharding.jump(keys, n), jump_sharding.jump(keys, n + 1)
        assert ((old == new) | (new == n)).all() and abs((new == n).mean() - 1 / (n + 1)) < 0.02


def test_sharding_query(spark):
    rows = QUERIES["op6_jump_sharding"](spark, SF001).collect()
    want = {r.doc_id: len(r.text.encode()) + 1 for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert {r.doc_id: r["size"] for r in rows} == want
    slots = defaultdict(list)
    for r in sorted(rows):
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9))
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())


def test_sharding_odd_rows(spark, odd_docs, no_docs):
    rows = jump_sharding.assign_shards(odd_docs, "doc_id", 3, ties=["text"]).collect()
    assert len(rows) == odd_docs.count() and {r.shard for r in rows if r.doc_id == 5} == {jump(5, 3)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jump_sharding.assign_shards(no_docs, "doc_id", 3).count() == 0
    assert jump_sharding.assign_shards(odd_docs.select("text"), "text", 4).groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


def test_written_shards(spark, odd_docs, tmp_dir):
    placed = jump_sharding.assign_shards(odd_docs.select("doc_id", "text"), "doc_id", 3)
    jump_sharding.write_shards(placed, f"{tmp_dir}/shards", rows_per_file=2)
    assert spark.read.parquet(f"{tmp_dir}/shards").count() == odd_docs.count()


def best(rows, k, scale):
    vectors = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for q, v in {(i, tuple(v)) for i, v in vectors if i is not None and i % 20 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i is None, i) for i, w in vectors if i != q), key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(q, n, i, -s) for n, (s, _, i) in enumerate(scores, 1)]
    return Counter(out)


@pytest.mark.parametrize("seed", range(4))
def test_topk_is_exact(spark, seed):
    rng = random.Random(seed)
    size = [40, 300, 700, 5][seed]
    values = [-2.0, -1.0, 0.0, 0.5, 1.0] if seed % 2 else None
    rows = [(i, [rng.choice(values) if values else rng.gauss(-0.3 * seed, 1) for _ in range(7)]) for i in range(size)]
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan"), 1.0]), (1060, [float("inf")]), (1080, []), (1100, [3.0]), (None, [1.0] * 9),
             (20, rows[2][1]), rows[0], rows[0]]
    if seed == 2:
        rows += [(2000 + i, rows[7][1]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = exact_topk.top_k(frame, frame.filter("vec_id % 20 = 0"), k=6, scale=64)
    assert Counter(tuple(r) for r in got.collect()) == best(rows, 6, 64)


def test_topk_wide_numbers_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [2.0 ** 24, 3.0]), (1, [2.0 ** 24, 1.0]), (2, [-2.0 ** 24, 2.0])], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(frame, frame.filter("vec_id = 0"), k=2, scale=64)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1, 2 ** 60 + 3 * 64 * 64), (0, 2, 2, -2 ** 60 + 6 * 64 * 64)]
    assert exact_topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = QUERIES[name](spark, SF001)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())

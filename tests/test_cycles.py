"""Cycles of nested jobs against a search from every job."""
import random

import pytest

from sluice.operators.cycles import components, contract, find_cycles, trim
from sluice.operators.runlog import job_kind


def by_hand(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, todo = set(), list(out[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += out.get(n, ())
        if start in seen:
            found.add(start)
    return found


def found(spark, edges):
    return {r["job_id"] for r in find_cycles(spark.createDataFrame(edges, "job_id long, child_id long")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(5, 40)
    edges = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(int(n * rng.choice([0.8, 1.2, 2])))]
    edges += [(100 + i, 101 + i) for i in range(12)] + [(112, 100)] + [(200 + i, 201 + i) for i in range(15)] + [(105, 203), (3, 3), (300, 301), (301, 300)]
    assert found(spark, edges) == by_hand(edges)


def test_long_chain_and_large_cycle(spark):
    """100,000 jobs in a row are on no cycle, 30,000 in a ring all are; each round leaves clearly fewer edges."""
    chain = spark.range(100_000).selectExpr("id AS job_id", "id + 1 AS child_id")
    ring = spark.range(30_000).selectExpr("id + 1000000 AS job_id", "(id + 1) % 30000 + 1000000 AS child_id")
    edges = chain.union(ring).selectExpr("job_id AS a", "child_id AS b").checkpoint()
    fewer, taken = contract(trim(edges), 1)
    assert taken.count() > 130_000 // 5 and fewer.count() < 0.85 * edges.count()
    cycles = find_cycles(chain.union(ring))
    assert cycles.count() == 30_000 and cycles.agg({"job_id": "min"}).first()[0] == 1_000_000


def test_components_and_no_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5)], "a long, b long")
    groups = {}
    for r in components(edges).collect():
        groups.setdefault(r["colour"], set()).add(r["node"])
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({1, 2}), frozenset({3, 4})}
    assert found(spark, []) == set() and found(spark, [(1, 2)]) == set() and found(spark, [(7, 7)]) == {7}


def test_kinds_of_long_chains(spark):
    steps = [(i, "job", i + 1) for i in range(50)] + [(50, "sql", None)] + [(60, "job", 61), (61, "job", 60), (70, "job", 999), (80, "job", None), (90, "sql", None), (90, "export", None)]
    kinds = {r["job_id"]: r["kind"] for r in job_kind(spark.createDataFrame(steps, "job_id long, step_type string, target_job_id long")).collect()}
    assert kinds == {i: "sql" for i in range(51)} | {60: "job", 61: "job", 70: "job", 80: "job", 90: "job"}

"""Exact top-k search by the three-phase uniform threshold method.

A vector's components are split into ``LISTS`` groups.  For one query each
group is a list of local scores (the inner product over its components) and a
row's score is the sum over the lists.

1. Gather: the ``k`` best entries of every list, in every block of rows, are
   resolved; the k-th best of their exact scores is a safe cutoff of the query.
2. Collect: a row that reaches the cutoff has at least one local score of
   cutoff / ``LISTS``, so only entries from that uniform threshold on are
   collected.  What a missing list can add is bounded by the threshold; rows
   whose bound stays below the cutoff are dropped.
3. Resolve: the missing local scores of the rows that are left are added, and
   the k best (ties to the smaller id) are returned.

The threshold argument holds for scores of any sign.  Queries and rows meet in
a grid: rows are dealt evenly into blocks by a hash that includes their place,
queries into groups; each block meets each group in a task of bounded size.
Nothing is broadcast and nothing but counts reaches the driver.

Components become ``floor(scale * x)``.  Vectors that are null or hold null or
non-finite components take no part.  Vectors of different lengths count as
padded with zeros; empty vectors score 0.  A query never meets rows of its own
id.  Repeated rows rank each for itself; equal repeated queries are asked once.
Scores beyond 64 bits raise an error.  A null id is never a query and ranks
last among ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import cut

#: Lists a vector is split into, rows of a block, queries of a group, and scores held at once within a task.
LISTS, BLOCK, GROUP, TILE = 2, 8192, 16384, 1 << 20
#: Stands for a null id in ranking.
NO_ID = np.iinfo(np.int64).max


def scaled(vector: Column, scale: int) -> Column:
    """Integer components, or null where the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(fit, whole)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as one zero-padded matrix."""
    lists = column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()[offsets[0]:offsets[-1]] if len(lists) else np.empty(0)
    sizes = np.diff(offsets)
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Grid:
    """One group of queries against one block of rows."""

    def __init__(self, queries: pa.Table, rows: pa.Table):
        widths = [int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (queries, rows)]
        self.width = max(1, *widths)
        self.q, self.x = _matrix(queries["v"], self.width), _matrix(rows["v"], self.width)
        self.q_ids, self.x_ids = (t["id"].fill_null(NO_ID).to_numpy() for t in (queries, rows))
        most = np.abs(self.q).max(initial=0) * np.abs(self.x).max(initial=0) * self.width
        if most >= 2 ** 63:
            raise ArithmeticError("inner products exceed 64 bits")
        self.kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
        self.q, self.x = self.q.astype(self.kind), self.x.astype(self.kind)
        self.lists = [slice(a[0], a[-1] + 1) for a in np.array_split(np.arange(self.width), min(LISTS, self.width))]

    def tiles(self) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
        """Queries in turn, with their local scores by list and the rows that are not theirs."""
        step = max(1, TILE // max(1, len(self.x)))
        for a in range(0, len(self.q), step):
            s = slice(a, a + step)
            yield s, [self.q[s, c] @ self.x[:, c].T for c in self.lists], self.q_ids[s, None] != self.x_ids[None, :]

    def gather(self, k: int) -> list[np.ndarray]:
        """Phase 1: for every query, exact scores of the rows that top a list here; at most k of them."""
        out: list[np.ndarray] = []
        least = np.iinfo(np.int64).min if self.kind is np.int64 else -np.inf
        for s, local, other in self.tiles():
            total = sum(local[1:], local[0].copy())
            top = np.zeros(other.shape, bool)
            for scores in local:
                masked = np.where(other, scores, least)
                if masked.shape[1] > k:
                    best = np.argpartition(masked, masked.shape[1] - k, axis=1)[:, -k:]
                    np.put_along_axis(top, best, True, axis=1)
                else:
                    top[:] = True
            top &= other
            out += [np.sort(t[m])[::-1][:k].astype(np.int64) for t, m in zip(total, top)]
        return out

    def resolve(self, cutoff: np.ndarray, known: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Phases 2 and 3: per query, the ids and exact scores of the k best rows here that reach its cutoff."""
        m = len(self.lists)
        for s, local, other in self.tiles():
            need = cutoff[s, None].astype(self.kind)
            above = [~known[s, None] | (m * part >= need) for part in local]
            hit = np.logical_or.reduce(above) & other
            rows, cols = np.nonzero(hit)
            scores = np.stack([part[rows, cols] for part in local])
            seen = np.stack([part[rows, cols] for part in above])
            # lists that have not named the row add less than the threshold each
            bound = (np.where(seen, m * scores, 0) + np.where(seen, 0, need[rows, 0])).sum(0)
            left = ~known[s][rows] | (bound >= m * need[rows, 0])
            rows, cols = rows[left], cols[left]
            total = scores[:, left].sum(0).astype(np.int64)
            keep = ~known[s][rows] | (total >= cutoff[s][rows])
            rows, ids, total = rows[keep], self.x_ids[cols[keep]], total[keep]
            order = np.lexsort((ids, -total, rows))
            rows, ids, total = rows[order], ids[order], total[order]
            starts = np.searchsorted(rows, np.arange(other.shape[0] + 1))
            for i in range(other.shape[0]):
                a, z = starts[i], min(starts[i] + k, starts[i + 1])
                if a < z:
                    yield s.start + i, ids[a:z], total[a:z]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of largest inner product for every query: ``query_id, rank, vec_id, score``."""
    spark = rows.sparkSession
    x = rows.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"), F.monotonically_increasing_id().alias("pos")).filter("v is not null")
    q = queries.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v")).filter("v is not null and id is not null").distinct()
    n_rows, n_queries = x.count(), q.count()
    blocks = max(-(-n_rows // BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // 256)), 1)
    groups = max(1, -(-n_queries // GROUP))

    x = x.withColumn("b", F.pmod(F.xxhash64("id", "pos"), F.lit(blocks)))
    x = x.select("id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * blocks + F.col("b"))).alias("cell"))

    def dealt(q: DataFrame) -> DataFrame:
        q = q.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups)))
        return q.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.col("g") * blocks + b))).drop("g")

    def gather(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "scores": pa.array([], pa.list_(pa.int64()))})
        scores = Grid(queries, rows).gather(k)
        return pa.table({"id": queries["id"], "v": queries["v"], "scores": pa.array([s.tolist() for s in scores], pa.list_(pa.int64()))})

    def resolve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            known = queries["cutoff"].is_valid().to_numpy()
            for i, ids, scores in Grid(queries, rows).resolve(queries["cutoff"].fill_null(0).to_numpy(), known, k):
                out[0] += [queries["query"][i].as_py()] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "vec_id", "score"), out)})

    by_cell = x.groupBy("cell")
    local = dealt(q).groupBy("cell").cogroup(by_cell).applyInArrow(gather, "id long, v array<double>, scores array<long>")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k)
    cutoffs = local.groupBy("id", "v").agg(best.alias("best"))
    cutoffs = cutoffs.select("id", "v", F.xxhash64("id", "v").alias("query"), F.when(F.size("best") == k, F.element_at("best", -1)).alias("cutoff"))
    cutoffs = cut(cutoffs, "topk-cutoffs")
    found = dealt(cutoffs).groupBy("cell").cogroup(by_cell).applyInArrow(resolve, "query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = cutoffs.select("query", F.col("id").alias("query_id"))
    return found.join(names, "query").select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


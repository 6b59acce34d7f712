"""Quality classifier: a sparse rule ensemble.

Small trees are boosted on statistics of labelled texts; every path from a
root becomes a conjunctive rule; lasso logistic regression keeps few of them;
the kept rules are compiled into one Spark column expression, so scoring is a
projection over all documents.

Only fitting uses a sample: at most ``SAMPLE`` labelled rows, those of lowest
hash, which is the documented bound of what reaches the driver.  Labels of
held-out rows are never read into it.  Several labels of one document count as
their largest; null labels not at all.  Without any labels, or with labels of
one kind only, every score is the share of label 1 (1 without labels).

Null text counts as empty, and is scored.  Repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.text_stats import PREFIX, with_statistics

SAMPLE = 20_000
TREES, DEPTH, RATE, LEAF, CUTS = 40, 3, 0.2, 20, 48
L1, ROUNDS = 0.001, 400
SEED = 17


def features() -> dict[str, Column]:
    """Statistics that rules compare, as columns over the measured table."""
    s = lambda n: F.col(PREFIX + n).cast("double")
    words, chars, lines = F.greatest(s("n_words"), F.lit(1.0)), F.greatest(s("word_chars"), F.lit(1.0)), F.greatest(s("n_lines"), F.lit(1.0))
    return {
        "words": s("n_words"), "word_length": s("word_chars") / words, "symbols": s("n_symbols") / words, "exclaims": s("n_exclaim") / words,
        "bars": s("n_bars") / words, "upper": s("n_upper") / chars, "digits": s("n_digits") / chars, "punctuation": s("n_punct") / words,
        "wide": s("n_wide") / chars, "distinct": s("n_distinct") / words, "repeats": s("n_repeat_words") / words,
        "dup_lines": s("n_dup_lines") / lines, "line_words": s("n_words") / lines, "longest": s("longest"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is above, threshold)."""
    tests: frozenset[tuple[str, bool, float]]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[f] > t) if above else (x[f] <= t) for f, above, t in self.tests])

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, above, t in sorted(self.tests):
            out = out & ((columns[f] > F.lit(t)) if above else (columns[f] <= F.lit(t)))
        return out


@dataclass
class Model:
    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, columns: dict[str, Column]) -> Column:
        margin = F.lit(self.intercept)
        for rule in sorted(self.weights, key=lambda r: sorted(r.tests)):
            margin = margin + F.when(rule.column(columns), F.lit(self.weights[rule])).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, tests: tuple, names: list[str]) -> list[tuple[tuple, np.ndarray, float]]:
    """Grow a tree on binned features; a list of (path, rows, value) for every node below the root."""
    if len(tests) == DEPTH or len(rows) < 2 * LEAF:
        return []
    g, h, best = gradient[rows], hessian[rows], (1e-9, None)
    total_g, total_h = g.sum(), h.sum()
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        binned = x[rows, j]
        n = np.cumsum(np.bincount(binned, minlength=len(c) + 1))[:-1]
        left_g = np.cumsum(np.bincount(binned, g, len(c) + 1))[:-1]
        left_h = np.cumsum(np.bincount(binned, h, len(c) + 1))[:-1]
        gain = left_g ** 2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g ** 2 / (total_h + 1)
        gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (j, k))
    if best[1] is None:
        return []
    j, k = best[1]
    below = x[rows, j] <= k
    nodes = []
    for above, part in ((False, rows[below]), (True, rows[~below])):
        path = (*tests, (names[j], above, float(cuts[j][k])))
        nodes.append((path, part, float(gradient[part].sum() / (hessian[part].sum() + 1))))
        nodes += grow(x, cuts, gradient, hessian, part, path, names)
    return nodes


def rules_of(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """Paths of boosted trees, each grown on a random half of the rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    rng, margin, found = np.random.default_rng(SEED), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        half = np.sort(rng.choice(len(y), -(-len(y) // 2), replace=False))
        nodes = grow(binned, cuts, y - p, p * (1 - p), half, (), names)
        found |= {Rule(frozenset(path)): None for path, _, _ in nodes}
        inner = {path[:-1] for path, _, _ in nodes}
        for path, _, value in nodes:
            if path not in inner:
                margin[Rule(frozenset(path)).holds(dict(zip(names, x.T)))] += RATE * value
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute-value penalty, by accelerated proximal steps; the intercept is free."""
    n = len(y)
    z1 = np.concatenate([np.ones((n, 1), np.float32), z.astype(np.float32)], 1)
    v = np.ones(z1.shape[1], np.float32)
    for _ in range(20):
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(z1 @ v) ** 2 * 1.02)
    b = np.zeros(z1.shape[1])
    b[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = b.copy(), 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(z1 @ ahead.astype(np.float32))))
        nxt = ahead - step * (z1.T @ (p - y).astype(np.float32)).astype(float) / n
        nxt[1:] = np.sign(nxt[1:]) * np.maximum(np.abs(nxt[1:]) - step * L1, 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, b = nxt + (was - 1) / t * (nxt - b), nxt
    return float(b[0]), b[1:]


def fit_arrays(x: dict[str, np.ndarray], y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Model(30.0 if share == 1.0 else -30.0)
    names = sorted(x)
    rules = rules_of(np.stack([x[n] for n in names], 1), y, names)
    if not rules:
        return Model(float(np.log(y.mean() / (1 - y.mean()))))
    intercept, weights = lasso(np.stack([r.holds(x) for r in rules], 1), y)
    return Model(intercept, {r: float(w) for r, w in zip(rules, weights) if w})


def held_out(doc_id: str, folds: int = 5) -> Column:
    """Rows whose labels fitting never reads; a row without id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    """Fit on labelled rows of ``docs``, at most ``SAMPLE`` of them."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y")).filter("__y is not null")
    known = known.filter(~held_out("__id")).groupBy("__id").agg(F.max("__y").alias("__y"))
    known = known.orderBy(F.xxhash64("__id", F.lit(SEED)), "__id").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")
    measured = with_statistics(rows, "__text")
    wanted = features()
    got = measured.select("__id", F.xxhash64("__text").alias("__h"), "__y", *[c.alias(n) for n, c in wanted.items()])
    got = got.orderBy(F.xxhash64("__id", F.lit(SEED)), "__id", "__h").limit(SAMPLE).toPandas()
    return fit_arrays({n: got[n].to_numpy(float) for n in wanted}, got["__y"].to_numpy(float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with its statistics and ``__score``."""
    measured = with_statistics(docs, text_col)
    return measured.withColumn("__score", model.score(features()))

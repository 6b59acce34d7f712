"""Statistics, outlier rules and the rule ensemble."""
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import quality_rules as rules
from sluice.llm import rule_ensemble as ensemble
from sluice.llm import text_stats
from sluice.llm.queries import QUERIES
from tests.conftest import SF001, SF01

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_statistics_are_the_plain_counts(spark, odd_docs):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "é#", "c|\n", "\x0b", "\x85", " ", "日本"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()] + [r.text for r in odd_docs.collect()] + ["x " * 7, "x " * 8, "x " * 9, "\n\n", "a\n a\na"]
    for t in texts:
        assert text_stats.measure(t)[:5] == plain_stats(t), repr(t and t[:80])


def test_outlier_query(spark):
    rows = QUERIES["op7_robust_outliers"](spark, SF01).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_stats(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    good = [kept[i] for i, q in labels.items() if q and i in kept]
    bad = [kept[i] for i, q in labels.items() if not q and i in kept]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


def subset(x, mu, w):
    """Rows in the lowest bins of distance that hold the share."""
    bins = np.minimum(np.floor(np.sqrt((((x - mu) @ w.T) ** 2).sum(1)) * rules.BINS), rules.LAST_BIN)
    return x[bins <= np.searchsorted(np.cumsum(np.bincount(bins.astype(int))), np.ceil(rules.SHARE * len(x)))]


def log_det(rows):
    return np.linalg.slogdet(np.cov(rows.T, bias=True) + rules._noise())[1]


def plain_mcd(x):
    """Mean and scatter of the least determinant that the fixed starts lead to, on an array of fixed-point features."""
    noise, p = rules._noise(), rules.P
    q = np.percentile(x, [100 * k for k in rules.QUANTILES], axis=0)
    spans = q[10:] - q[:11]
    at, every = spans.argmin(axis=0), np.arange(p)
    half = spans[at, every]
    starts = [(q[10], np.diag(((q[15] - q[5]) / 1.349) ** 2) + noise), (q[at, every] + half / 2, np.diag((half / 1.349) ** 2) + noise)]
    w = rules.whitening(starts[0][1])
    z = (x - q[10]) @ w.T
    z = np.round(z[:, :, None] * z[:, None, :] / np.maximum((z ** 2).sum(1), 1e-9)[:, None, None] * 2 ** 20).sum(0) / 2 ** 20 / len(x) * p
    back = np.linalg.inv(w)
    starts.append((q[10], back @ (z + 1e-3 * np.eye(p)) @ back.T))
    found = []
    for mu, cov in starts:
        w = rules.whitening(cov)
        for _ in range(rules.STEPS):
            near = subset(x, mu, w)
            mu, cov = near.mean(0), np.cov(near.T, bias=True)
            w = rules.whitening(rules.shrink() * cov + noise)
        found.append((log_det(near), len(found), mu, cov))
    return min(found, key=lambda f: f[:2])[2:]


def drawn(n, own, wide):
    return tuple((a * n + b * rules.PRIOR) / (n + rules.PRIOR) for a, b in zip(own, wide))


def planted(spark, sizes, seed=3):
    rng, rows = random.Random(seed), []
    for (lang, source), n in sizes.items():
        for i in range(n):
            junk = i % 10 == 0
            words = ["w" * max(1, round(rng.gauss(5, 2))) + str(rng.randint(0, 10 ** 6)) for _ in range(rng.randint(30, 90))]
            rows.append((len(rows), " ".join("$$%" + w if junk else w for w in words), lang, source, junk))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean").repartition(6)


def test_estimates_are_the_plain_steps_by_group(spark):
    docs = planted(spark, {("en", "big"): 900, ("en", "small"): 40, ("de", None): 120})
    stats = text_stats.with_statistics(docs, "text").drop("text")
    x = stats.select("lang", "source", *[c.alias(k) for k, c in rules.features().items()]).toPandas()
    got = {r["key"]: r for r in rules.fit(stats).collect()}
    assert set(got) == {"=en/=big", "=en/=small", "=de/-"}
    of = lambda rows: rows[list(rules.NOISE)].to_numpy(float)
    every = plain_mcd(of(x))
    for key, lang, mine in (("=en/=big", "en", x[x.source == "big"]), ("=en/=small", "en", x[x.source == "small"]), ("=de/-", "de", x[x.lang == "de"])):
        wide = x[x.lang == lang]
        mu, cov = drawn(len(mine), plain_mcd(of(mine)), drawn(len(wide), plain_mcd(of(wide)), every))
        w = rules.whitening(rules.shrink() * cov + rules._noise())
        assert np.allclose(got[key]["__mu"], mu) and np.allclose(np.reshape(got[key]["__w"], w.shape), w)
    judged = rules.judge(docs).collect()
    assert all(r["__kept"] != r.junk for r in judged)


def test_least_determinant_over_all_subsets(spark):
    """Small groups with a clump of far rows: no subset of the share has a clearly smaller determinant."""
    rng = np.random.default_rng(4)
    rows, groups = [], []
    for g in range(6):
        x = np.round(rng.normal(0, 400, (14, rules.P)) + rng.normal(0, 3000, rules.P))
        x[:3] += rng.choice([-1, 1], rules.P) * 9000 + rng.normal(0, 50, (3, rules.P)).round()
        groups.append(x)
        rows += [(str(g), i % 3, *map(int, r)) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "grp string, salt long, " + ", ".join(f"__f{j} long" for j in range(rules.P)))
    for r in rules.estimates(frame).collect():
        x, size = groups[int(r["grp"])], int(np.ceil(rules.SHARE * 14))
        least = min(log_det(x[list(some)]) for some in itertools.combinations(range(14), size))
        mine = np.linalg.slogdet(np.reshape(r["cov"], (rules.P, rules.P)) + rules._noise())[1]
        assert mine <= least + 1.0, (mine, least)  # a bin may hold a row or two more than the share
        assert np.abs(np.array(r["mu"]) - x[3:].mean(0)).max() < 400


def test_small_groups_share_and_odd_rows(spark, odd_docs, no_docs):
    docs = planted(spark, {("en", f"s{i}"): 12 for i in range(15)} | {("de", "x"): 5, (None, "x"): 4})
    assert {r["__kept"] for r in rules.judge(docs).filter("not junk").collect()} == {True}
    judged = rules.judge(odd_docs)
    assert judged.columns[:len(odd_docs.columns)] == odd_docs.columns and judged.count() == odd_docs.count()
    clash = odd_docs.selectExpr("*", "'x' AS __f0", "'x' AS __key", "'x' AS __mu", "true AS __kept")
    again = rules.judge(clash)
    assert again.select("__f0", "__key", "__mu").distinct().collect() == [("x", "x", "x")] and again.columns.count("__kept") == 1
    assert {r.doc_id for r in judged.filter("__base_failed").collect()} >= {1, 2, 3, 7}
    assert rules.judge(no_docs).count() == 0 and rules.judge(no_docs, keep_text=False).count() == 0


def test_chi_square():
    assert abs(rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(rules.chi2_cdf(6.6257, 5) - 0.75) < 1e-4


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = QUERIES["op10_rule_ensemble"](spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    hits = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(hits) > 40 and np.mean(hits) >= 0.95


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(2)
    x = {"a": rng.normal(size=800), "b": rng.integers(0, 4, 800).astype(float), "c": rng.normal(size=800)}
    y = ((x["a"] > 0.3) & (x["b"] <= 1) | (x["c"] > 1.5)).astype(float)
    model = ensemble.fit_arrays(x, y)
    margin = model.intercept + sum(w * r.holds(x) for r, w in model.weights.items())
    assert 0 < len(model.weights) < 200 and (((margin > 0) == y).mean() > 0.95)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values())], "a double, b double, c double")
    got = [r[0] for r in frame.select(model.score({n: F.col(n) for n in x})).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


def test_lasso_stops_at_the_optimum():
    rng = np.random.default_rng(1)
    z = rng.random((600, 12)) < 0.4
    y = (rng.random(600) < 1 / (1 + np.exp(-(2.0 * z[:, 0] - 1.5 * z[:, 1])))).astype(float)
    b0, b = ensemble.lasso(z, y)
    slope = z.T @ (1 / (1 + np.exp(-(b0 + z @ b))) - y) / len(y)
    assert np.all(np.abs(slope[b == 0]) <= ensemble.L1 + 1e-4) and np.allclose(slope[b != 0], -ensemble.L1 * np.sign(b[b != 0]), atol=2e-4)


def test_ensemble_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 0, 0) for i in range(8)] + [(5, None, 0), (None, 1, 0)], none.schema)
    assert {r["__score"] for r in ensemble.score(odd_docs, ensemble.fit(odd_docs, none)).collect()} == {1 / (1 + np.exp(-30.0))}
    scored = ensemble.score(odd_docs, ensemble.fit(odd_docs, one))
    assert max(r["__score"] for r in scored.collect()) < 1e-9 and scored.count() == odd_docs.count()
    assert ensemble.score(no_docs, ensemble.fit(no_docs, one)).count() == 0


@pytest.mark.parametrize("ids", [list(range(50))])
def test_held_out_labels_are_not_read(spark, ids):
    docs = spark.createDataFrame([(i, f"word {i} " * (i + 1)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(ensemble.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert ensemble.fit(docs, labels) == ensemble.fit(docs, flipped)

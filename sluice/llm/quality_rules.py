"""Quality rules: robust multivariate outliers.

Documents first pass fixed base rules.  Of those that do, a minimum-covariance-
determinant estimate (location and scatter of the ``SHARE`` of rows that lie
closest together) is made for each language and source, for each language and for
all rows, over transformed statistics.  Several fixed starts (medians with
quartiles, the shortest halves of the features, spatial signs) are each improved
by concentration steps: every step measures all rows against the present
estimate, keeps the nearest share of each group and re-estimates from them.  Of
the starts the one whose subset has the least determinant stands.  A step is one
grouped aggregation: rows are summed per (group, start, distance bin), so a group
that holds most rows is summed in parallel, and the subset of a group is its
lowest bins that together reach the share.  Features are fixed-point integers, so
sums do not depend on the order of tasks.

The estimate of a source is drawn towards its language's, and that towards the
one of all rows, by the weight of ``PRIOR`` rows: a source of few rows is judged
mostly as its language is, one of many by itself, and there is no size at which
the rule changes.  Rows farther than a chi-square quantile (Mahalanobis distance)
are rejected.

Null or empty texts fail the base rules (no words).  Null language or source
is a group of its own.  Long texts are measured whole.  Repeated rows count each.
An empty table gives no rows.  Other columns are kept as they are; columns
``__base_failed``, ``__distance``, ``__kept``, the statistics (``__s_*``) and names
that begin with ``__mcd_`` are replaced or left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut
from sluice.llm.text_stats import PREFIX, with_statistics

#: Share of a group's rows that an estimate rests on.
SHARE = 0.75
#: Concentration steps; later ones move the estimate by less than a bin.
STEPS = 5
#: Rows with a distance beyond the chi-square quantile of this tail are rejected.
TAIL = 1e-6
#: Rows that the wider estimate counts for in a narrower one.
PRIOR = 50
#: Units of a feature.
UNIT = 1024
#: Standard deviation that is added to each feature's own, so that a feature which hardly varies rejects only what is far off.
NOISE = {"length": 0.5, "word_length": 0.08, "symbols": 0.5, "dup_lines": 0.15, "repeats": 0.15}
P = len(NOISE)
#: Bins to a unit of distance, and the last bin.
BINS, LAST_BIN = 8, 400

#: Rows of a group are dealt to so many keys where they meet its estimate, and summed over them before they meet.
SALTS = 32

#: Quantiles that the starts are taken from: quartiles, and the ends of halves.
QUANTILES = [k / 20 for k in range(21)]
_PARAMS = "grp string, start int, __mu array<double>, __w array<double>"
_ESTIMATES = "grp string, start int, n long, mu array<double>, cov array<double>, det double"


def stat(name: str) -> Column:
    return F.col(PREFIX + name)


def base_failed() -> Column:
    return (stat("n_words") < 20) | (100 * stat("n_repeat_words") > 30 * stat("n_words"))


def features() -> dict[str, Column]:
    words = stat("n_words").cast("double")
    some, lines = F.greatest(words, F.lit(1.0)), F.greatest(stat("n_lines").cast("double"), F.lit(1.0))
    raw = {
        "length": F.log1p(words),
        "word_length": F.log((stat("word_chars") + 1) / some),
        "symbols": F.log1p(100 * stat("n_symbols") / some),
        "dup_lines": F.sqrt(stat("n_dup_lines") / lines),
        "repeats": F.sqrt(stat("n_repeat_words") / some),
    }
    return {k: F.round(v * UNIT).cast("long") for k, v in raw.items()}


def chi2_cdf(x: float, p: int) -> float:
    """Chi-square distribution, by the series of the incomplete gamma function."""
    a, z = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 1000):
        term *= z / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


def shrink() -> float:
    """The nearest share of normal rows varies less than all of them: by this factor."""
    return SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)


def whitened(own: str = "__") -> list[Column]:
    """A row's offset from the estimate in columns ``mu`` and ``w`` (its whitening matrix, by rows), in units of its scatter."""
    off = [F.col(f"{own}f{j}") - F.col(f"{own}mu")[j] for j in range(P)]
    return [sum((F.col(f"{own}w")[i * P + j] * off[j] for j in range(1, i + 1)), F.col(f"{own}w")[i * P] * off[0]) for i in range(P)]


def distance(own: str = "__") -> Column:
    """Squared Mahalanobis distance."""
    rows = whitened(own)
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def group_key(lang: str, source: str) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.col(c).cast("string"), "([\\\\/])", "\\\\$1")), F.lit("-"))
    return F.concat(part(lang), F.lit("/"), part(source))


def whitening(cov: np.ndarray) -> np.ndarray:
    """Lower-triangular w with w (x - mu) of unit scatter."""
    return np.linalg.inv(np.linalg.cholesky(cov))


def _noise() -> np.ndarray:
    return np.diag([(s * UNIT) ** 2 for s in NOISE.values()])


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """Start 0: medians, and scatter along the axes from the distance between quartiles (1.349 deviations of normal rows).
    Start 1: middles of the shortest halves, and scatter from their lengths."""
    out = []
    for r in rows.to_dict("records"):
        q = np.array([r[f"q{j}"] for j in range(P)], float)
        spans = q[:, 10:] - q[:, :11]
        at = spans.argmin(axis=1)
        half = spans[np.arange(P), at]
        for start, mid, scale in ((0, q[:, 10], (q[:, 15] - q[:, 5]) / 1.349), (1, q[np.arange(P), at] + half / 2, half / 1.349)):
            out.append((r["grp"], start, mid.tolist(), whitening(np.diag(scale ** 2) + _noise()).ravel().tolist()))
    return pd.DataFrame(out, columns=["grp", "start", "__mu", "__w"])


def _signs(sums: pd.DataFrame) -> pd.DataFrame:
    """Start 2: the first one's location, with the directions in which rows lie from it (each row counts the same, however far)."""
    out = []
    for r in sums.to_dict("records"):
        cov = np.empty((P, P))
        for i in range(P):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] / max(r["n"], 1) * P
        back = np.linalg.inv(np.array(r["w"], float).reshape(P, P))
        out.append((r["grp"], 2, list(r["mu"]), whitening(back @ (cov + 1e-3 * np.eye(P)) @ back.T).ravel().tolist()))
    return pd.DataFrame(out, columns=["grp", "start", "__mu", "__w"])


def _subset(bins: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and scatter of the lowest bins of one group that hold its share, and the rows of the group."""
    bins = bins.sort_values("bin")
    counts = bins["n"].to_numpy(np.int64)
    take = int(np.searchsorted(np.cumsum(counts), math.ceil(SHARE * counts.sum()))) + 1
    near = bins.iloc[:take]
    n = float(near["n"].sum())
    mu = np.array([float(sum(map(int, near[f"s{j}"]))) for j in range(P)]) / n
    cov = np.empty((P, P))
    for i in range(P):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = float(sum(map(int, near[f"p{i}_{j}"]))) / n - mu[i] * mu[j]
    return mu, cov, int(counts.sum())


def _step(bins: pd.DataFrame) -> pd.DataFrame:
    """The estimate that the next concentration step measures against."""
    mu, cov, _ = _subset(bins)
    return pd.DataFrame([(bins["grp"].iloc[0], int(bins["start"].iloc[0]), mu.tolist(), whitening(shrink() * cov + _noise()).ravel().tolist())], columns=["grp", "start", "__mu", "__w"])


def _estimate(bins: pd.DataFrame) -> pd.DataFrame:
    """The estimate that a start has led to, with its determinant (the noise included, so that features without scatter compare)."""
    mu, cov, n = _subset(bins)
    det = float(np.linalg.slogdet(cov + _noise())[1])
    return pd.DataFrame([(bins["grp"].iloc[0], int(bins["start"].iloc[0]), n, mu.tolist(), cov.ravel().tolist(), det)], columns=["grp", "start", "n", "mu", "cov", "det"])


def _binned(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Sums of the rows by group, start and bin of their distance."""
    near = rows.join(_salted(params), ["grp", "salt"]).withColumn("bin", F.least(F.floor(F.sqrt(distance()) * BINS), F.lit(LAST_BIN)))
    return near.groupBy("grp", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"__f{j}").alias(f"s{j}") for j in range(P)],
        *[F.sum(F.col(f"__f{i}") * F.col(f"__f{j}")).alias(f"p{i}_{j}") for i in range(P) for j in range(i + 1)])


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of least determinant of every group: ``grp, n, mu, cov``.  ``rows``: ``grp, salt, __f0 ...``."""
    levels = F.array(*[F.lit(q) for q in QUANTILES])
    quantiles = rows.groupBy("grp").agg(*[F.percentile(f"__f{j}", levels).alias(f"q{j}") for j in range(P)])
    params = cut(quantiles.groupBy("grp").applyInPandas(_starts, _PARAMS), "mcd-starts")
    first = params.filter("start = 0")
    near = rows.join(_salted(first), ["grp", "salt"])
    z = whitened()
    away = F.greatest(distance(), F.lit(1e-9))
    # fixed-point again, so that the order of tasks does not show
    products = [F.sum(F.round(z[i] * z[j] / away * (1 << 20)).cast("long")).alias(f"c{i}_{j}") for i in range(P) for j in range(i + 1)]
    signs = near.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *products)
    signs = signs.join(first.select("grp", F.col("__mu").alias("mu"), F.col("__w").alias("w")), "grp")
    signs = signs.withColumns({f"c{i}_{j}": F.col(f"c{i}_{j}") / (1 << 20) for i in range(P) for j in range(i + 1)})
    params = cut(params.union(signs.groupBy("grp").applyInPandas(_signs, _PARAMS)), "mcd-start")
    for _ in range(STEPS - 1):
        params = cut(_binned(rows, params).groupBy("grp", "start").applyInPandas(_step, _PARAMS), "mcd-step")
    ends = _binned(rows, params).groupBy("grp", "start").applyInPandas(_estimate, _ESTIMATES)
    best = ends.groupBy("grp").agg(F.min(F.struct("det", "start", "n", "mu", "cov")).alias("best"))
    return cut(best.select("grp", "best.n", "best.mu", "best.cov"), "mcd-estimates")


def _drawn(n: str, own: str, wide: str) -> Column:
    """An array drawn towards a wider one by the weight of ``PRIOR`` rows."""
    return F.zip_with(own, wide, lambda a, b: (a * F.col(n) + b * PRIOR) / (F.col(n) + PRIOR))


def _whitened(rows: pd.DataFrame) -> pd.DataFrame:
    ws = [whitening(shrink() * np.array(c, float).reshape(P, P) + _noise()).ravel().tolist() for c in rows["cov"]]
    return pd.DataFrame({"key": rows["key"], "__mu": rows["mu"], "__w": ws})


def fit(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Estimates by ``key``: ``key, __mu, __w``.  ``stats`` needs the statistic and the two group columns only."""
    key = group_key(lang, source)
    rows = stats.filter(~base_failed()).select(
        key.alias("key"), F.substring_index(key, "/", 1).alias("lkey"),
        *[c.alias(f"__f{j}") for j, c in enumerate(features().values())], (F.monotonically_increasing_id() % SALTS).alias("salt"))
    rows = cut(rows, "mcd-features")
    keys = cut(rows.groupBy("key", "lkey").agg(F.count(F.lit(1)).alias("n")), "mcd-groups")
    wide = rows.select(F.explode(F.array("key", F.concat("lkey", F.lit("/*")), F.lit("*"))).alias("grp"), "salt", *[f"__f{j}" for j in range(P)])
    found = estimates(cut(wide, "mcd-rows"))
    named = lambda name: found.select(F.col("grp").alias(f"{name}_grp"), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "mu", "cov")])
    met = keys.select("key", "lkey").join(named("own"), F.col("key") == F.col("own_grp")).join(named("lang"), F.concat("lkey", F.lit("/*")) == F.col("lang_grp"))
    met = met.withColumn("all_grp", F.lit("*")).join(named("all"), "all_grp")
    # a language drawn towards all rows, then a source towards its language
    met = met.withColumns({f"lang_{c}": _drawn("lang_n", f"lang_{c}", f"all_{c}") for c in ("mu", "cov")})
    met = met.withColumns({c: _drawn("own_n", f"own_{c}", f"lang_{c}") for c in ("mu", "cov")}).select("key", "mu", "cov")
    return cut(met.mapInPandas(lambda batches: map(_whitened, batches), "key string, __mu array<double>, __w array<double>"), "mcd-params")


def score(stats: DataFrame, estimates: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` with ``__base_failed, __distance`` (squared; null for rows that fail the base) and ``__kept``."""
    limit = chi2_quantile(1 - TAIL, P)
    names, own = [c for c in stats.columns if c not in {"__base_failed", "__distance", "__kept"}], "__mcd_"
    rows = stats.withColumns({f"{own}f{j}": c for j, c in enumerate(features().values())} | {f"{own}key": group_key(lang, source)})
    rows = rows.join(estimates.toDF(f"{own}key", f"{own}mu", f"{own}w"), f"{own}key", "left").withColumn("__base_failed", base_failed())
    rows = rows.withColumn("__distance", F.when(~F.col("__base_failed"), distance(own)))
    return rows.select(*names, "__base_failed", "__distance", F.coalesce(F.col("__distance") <= limit, F.lit(False)).alias("__kept"))


def judge(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """Every document with its statistics and verdict.  The estimates come
    from a compact statistics table; with ``keep_text`` the texts are measured
    once more on the way out, instead of being written and read in between."""
    measured = with_statistics(docs, text_col)
    if not keep_text:
        measured = cut(measured.drop(text_col), "text-stats")
        return score(measured, fit(measured, lang, source), lang, source)
    slim = with_statistics(docs.select(*{text_col, lang, source}), text_col).drop(text_col)
    return score(measured, fit(slim, lang, source), lang, source)

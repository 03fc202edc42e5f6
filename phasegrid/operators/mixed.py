"""Correlations of ordered and continuous variables: polychoric, polyserial, Pearson, and the nearest usable matrix.

Every pair of a kind is worked out from one aggregate over all rows: contingency counts for two ordered variables, counts and moments
of each level (by narrow bins of the standardised value where the likelihood is asked for) for an ordered and a continuous one. What
reaches the driver is bounded by levels and bins, never by rows; more than MOST_LEVELS levels raise.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import normal_ppf
from .linear import MOST_LEVELS, pearson_long

#: Bins of a standard deviation, and how far from the mean they reach, in the likelihood of a polyserial pair.
PER_SD, REACH = 64, 8
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)
_GOLDEN = (math.sqrt(5) - 1) / 2
_ERFC = np.vectorize(math.erfc, otypes=[float])


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _ERFC(-np.asarray(x, float) / math.sqrt(2))


def thresholds(counts: np.ndarray) -> np.ndarray:
    """Normal quantiles between the levels, with -8 and 8 at the ends."""
    share = np.cumsum(counts)[:-1] / counts.sum()
    return np.array([-8.0, *(min(max(normal_ppf(x), -8.0), 8.0) for x in share), 8.0])


def _least(loss, rounds: int = 60) -> float:
    """Where a loss with one valley is least, between correlations of -0.999 and 0.999."""
    lo, hi = -0.999, 0.999
    x, y = hi - _GOLDEN * (hi - lo), lo + _GOLDEN * (hi - lo)
    fx, fy = loss(x), loss(y)
    for _ in range(rounds):
        if fx < fy:
            hi, y, fy = y, x, fx
            x = hi - _GOLDEN * (hi - lo)
            fx = loss(x)
        else:
            lo, x, fx = x, y, fy
            y = lo + _GOLDEN * (hi - lo)
            fy = loss(y)
    return (lo + hi) / 2


def binormal(h: np.ndarray, k: np.ndarray, r: float) -> np.ndarray:
    """P(X < h[i], Y < k[j]) at correlation r for all i and j: the density integrated over the correlation from 0 to r."""
    t = r / 2 * (_NODES + 1)
    hh, kk = h[:, None, None], k[None, :, None]
    inside = np.exp(-(hh * hh - 2 * t * hh * kk + kk * kk) / (2 * (1 - t * t))) / (2 * np.pi * np.sqrt(1 - t * t))
    return np.outer(_cdf(h), _cdf(k)) + (inside * (r / 2 * _WEIGHTS)).sum(-1)


def polychoric_of(counts: np.ndarray) -> float:
    """Correlation of the normal variables behind a contingency table: thresholds from the margins, then the likelihood's peak."""
    counts = counts[counts.sum(1) > 0][:, counts.sum(0) > 0]
    if min(counts.shape) < 2:
        return float("nan")
    u, v = thresholds(counts.sum(1)), thresholds(counts.sum(0))

    def loss(r: float) -> float:
        cell = np.diff(np.diff(binormal(u, v, r), axis=0), axis=1)
        return -float((counts * np.log(np.maximum(cell, 1e-12))).sum())

    return _least(loss)


def polyserial_of(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> float:
    """From number, sum and sum of squares of each level in order: the product-moment correlation with the levels' places, times their deviation over the summed normal densities at the thresholds."""
    n = counts.sum()
    keep = counts > 0
    counts, sums, squares = counts[keep], sums[keep], squares[keep]
    if len(counts) < 2:
        return float("nan")
    place = np.arange(1.0, len(counts) + 1)
    mean, at = sums.sum() / n, (counts * place).sum() / n
    var, spread = squares.sum() / n - mean * mean, (counts * place * place).sum() / n - at * at
    if var <= 0:
        return float("nan")
    slope = ((place * sums).sum() / n - at * mean) / math.sqrt(var)  # covariance of the place and the standardised value
    inner = thresholds(counts)[1:-1]
    return float(slope / (np.exp(-inner * inner / 2) / math.sqrt(2 * math.pi)).sum())


def polyserial_likelihood(counts: np.ndarray, z: np.ndarray) -> float:
    """The peak of the likelihood given the thresholds; counts[level, bin] rows whose standardised value is z[bin]."""
    keep = counts.sum(1) > 0
    counts = counts[keep]
    if len(counts) < 2:
        return float("nan")
    cut = thresholds(counts.sum(1))

    def loss(r: float) -> float:
        upto = _cdf((cut[:, None] - r * z[None, :]) / math.sqrt(1 - r * r))
        return -float((counts * np.log(np.maximum(np.diff(upto, axis=0), 1e-300))).sum())

    return _least(loss)


def _pairs(names_a: list[str], names_b: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in names_a for b in names_b]


def _long(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, x, y) of every row and pair with both values known."""
    cells = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for k, (a, b) in enumerate(pairs)))
    return df.select(F.inline(cells)).where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def _levels(rows: list, pairs: list[tuple[str, str]], side: str) -> dict[int, list[float]]:
    seen: dict[int, set] = defaultdict(set)
    for r in rows:
        seen[r.pair].add(r[side])
    for k, values in seen.items():
        if len(values) > MOST_LEVELS:
            raise ValueError(f"{pairs[k]} has more than {MOST_LEVELS} levels")
    return {k: sorted(v) for k, v in seen.items()}


def _bounded(df: DataFrame, most: int) -> list:
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {MOST_LEVELS} levels in an ordered variable")
    return got


def polychoric_long(df: DataFrame, ordered: list[str]) -> list[dict]:
    """a, b, r and n of each unordered pair of ordered variables, over rows where both are known; r is NaN for a variable of one level."""
    pairs = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :]]
    if not pairs:
        return []
    rows = _bounded(_long(df, pairs).groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")), len(pairs) * MOST_LEVELS**2)
    xs, ys = _levels(rows, pairs, "x"), _levels(rows, pairs, "y")
    tables = {k: np.zeros((len(xs[k]), len(ys[k]))) for k in xs}
    for r in rows:
        tables[r.pair][xs[r.pair].index(r.x), ys[r.pair].index(r.y)] = r.n
    return [{"a": a, "b": b, "kind": "polychoric", "r": polychoric_of(tables[k]) if k in tables else float("nan"), "n": int(tables[k].sum()) if k in tables else 0} for k, (a, b) in enumerate(pairs)]


def level_moments(df: DataFrame, ordered: list[str], continuous: list[str]) -> DataFrame:
    """(a, b, level, n, total, squares) of each ordered variable's levels and each continuous one, over rows where both are known."""
    pairs = _pairs(ordered, continuous)
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    got = _long(df, pairs).groupBy("pair", F.col("x").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.sum(F.col("y") * F.col("y")).alias("squares"))
    return got.withColumn("_n", F.element_at(names, F.col("pair") + 1)).select("_n.a", "_n.b", "level", "n", "total", "squares")


def polyserial_long(df: DataFrame, ordered: list[str], continuous: list[str], likelihood: bool = False) -> list[dict]:
    """a (ordered), b (continuous), r and n of each such pair; by moments, or by the likelihood with values in bins of 1/64 deviation."""
    pairs = _pairs(ordered, continuous)
    if not pairs:
        return []
    held: dict[tuple[str, str], list] = defaultdict(list)
    for r in _bounded(level_moments(df, ordered, continuous), len(pairs) * MOST_LEVELS):
        held[r.a, r.b].append(r)
    if any(len(v) > MOST_LEVELS for v in held.values()):
        raise ValueError(f"more than {MOST_LEVELS} levels in an ordered variable")
    out, known = {}, {}
    for pair, rows in held.items():
        rows.sort(key=lambda r: r.level)
        n, s, q = (np.array([r[c] for r in rows], float) for c in ("n", "total", "squares"))
        mean = s.sum() / n.sum()
        known[pair] = (n.sum(), mean, math.sqrt(max(q.sum() / n.sum() - mean * mean, 0.0)), [r.level for r in rows])
        out[pair] = polyserial_of(n, s, q)
    if likelihood:
        scale = F.array(*(F.struct(F.lit(float(known.get(p, (0, 0.0, 0.0))[1])).alias("m"), F.lit(float(known.get(p, (0, 0.0, 0.0))[2]) or None).cast("double").alias("s")) for p in pairs))
        z = (F.col("y") - F.element_at(scale, F.col("pair") + 1)["m"]) / F.element_at(scale, F.col("pair") + 1)["s"]
        bins = F.least(F.greatest(F.floor(z * PER_SD), F.lit(-REACH * PER_SD)), F.lit(REACH * PER_SD - 1)).cast("int")
        table = _long(df, pairs).groupBy("pair", "x", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null").collect()  # levels x bins rows a pair
        counts = {k: np.zeros((len(known[p][3]), 2 * REACH * PER_SD)) for k, p in enumerate(pairs) if p in known}
        for r in table:
            counts[r.pair][known[pairs[r.pair]][3].index(r.x), r.bin + REACH * PER_SD] = r.n
        middle = (np.arange(2 * REACH * PER_SD) + 0.5) / PER_SD - REACH
        for k, c in counts.items():
            used = c.sum(0) > 0
            out[pairs[k]] = polyserial_likelihood(c[:, used], middle[used]) if used.any() else float("nan")
    return [{"a": a, "b": b, "kind": "polyserial", "r": out.get((a, b), float("nan")), "n": int(known[a, b][0]) if (a, b) in known else 0} for a, b in pairs]


def smoothed(r: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """The matrix itself if all its eigenvalues are at least `least`; else lower ones are raised to 100 times that, the sum is restored and the diagonal scaled to 1. Missing entries raise."""
    if not np.isfinite(r).all():
        raise ValueError("a correlation is missing: drop constant variables first")
    value, vector = np.linalg.eigh(r)
    if value.min() >= least:
        return r
    value = np.where(value < least, 100 * least, value)
    value *= len(r) / value.sum()
    whole = (vector * value) @ vector.T
    d = np.sqrt(np.diag(whole))
    out = whole / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return (out + out.T) / 2


def mixed_correlation(df: DataFrame, ordered: list[str], continuous: list[str] = (), likelihood: bool = False) -> list[dict]:
    """a, b, kind, r and n of every unordered pair: polychoric, polyserial or pearson by the kinds of the two variables. Pairwise complete rows.

    Null and NaN values take no part; a variable of one level gives NaN; an empty table gives NaN with n = 0; columns not named are ignored.
    """
    continuous = list(continuous)
    out = polychoric_long(df, ordered) + polyserial_long(df, ordered, continuous, likelihood)
    if len(continuous) > 1:
        plain = df.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in continuous))
        out += [{"a": r.a, "b": r.b, "kind": "pearson", "r": float("nan") if r.r is None else r.r, "n": r.n} for r in pearson_long(plain, continuous).collect()]
    return out


def mixed_matrix(df: DataFrame, ordered: list[str], continuous: list[str] = (), likelihood: bool = False, smooth: bool = True) -> np.ndarray:
    """The matrix of mixed_correlation over [*ordered, *continuous], made positive where needed; ready for components_of()."""
    names = [*ordered, *continuous]
    r = np.eye(len(names))
    for x in mixed_correlation(df, ordered, continuous, likelihood):
        i, j = names.index(x["a"]), names.index(x["b"])
        r[i, j] = r[j, i] = x["r"]
    return smoothed(r) if smooth else r

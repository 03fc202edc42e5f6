"""Tail probabilities of the usual test distributions, for scalars on the driver or in small helpers."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * out


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Chance that the range of k normal means over their deviation (df degrees) exceeds q, by nested quadrature."""
    if q <= 0:
        return 1.0
    x, w = _nodes(96)
    phi = np.vectorize(normal_cdf)

    def range_cdf(r: np.ndarray) -> np.ndarray:
        z, dz = 8 * x, 8 * w
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        inner = np.maximum(phi(z) - phi(z[None, :] - r[:, None]), 0)
        return np.minimum(k * (inner ** (k - 1) * density * dz).sum(1), 1.0)

    if df > 5000:
        return float(1 - range_cdf(np.array([q]))[0])
    # s = chi / sqrt(df): its density around 1.
    spread = 9 / math.sqrt(2 * df)
    lo, hi = max(1e-9, 1 - spread), 1 + spread * (2 if df < 5 else 1)
    s, ds = (hi - lo) / 2 * x + (hi + lo) / 2, (hi - lo) / 2 * w
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - (range_cdf(q * s) * np.exp(log) * ds).sum())))


def hypergeometric_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact p of the 2x2 table: all tables no likelier than this one."""
    n, row, col = a + b + c + d, a + b, a + c
    log = lambda x: math.lgamma(row + 1) - math.lgamma(x + 1) - math.lgamma(row - x + 1) + math.lgamma(n - row + 1) - math.lgamma(col - x + 1) - math.lgamma(n - row - col + x + 1) - (math.lgamma(n + 1) - math.lgamma(col + 1) - math.lgamma(n - col + 1))
    lo, hi = max(0, col - (n - row)), min(row, col)
    p = [math.exp(log(x)) for x in range(lo, hi + 1)]
    own = p[a - lo]
    return min(1.0, sum(x for x in p if x <= own * (1 + 1e-7)))

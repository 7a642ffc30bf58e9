"""Distributions and tests on numpy arrays, without scipy."""

from __future__ import annotations

import math

import numpy as np


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: arguments under 8 are shifted up, then Stirling's series."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1)), shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y


def poisson_logpmf(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    mean = np.maximum(mean, 1e-12)
    return k * np.log(mean) - mean - lgamma(np.asarray(k) + 1.0)


def negbin_logpmf(k: np.ndarray, mean: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Mean and dispersion theta (variance mean + mean^2 / theta)."""
    mean, theta, k = np.maximum(mean, 1e-12), np.maximum(theta, 1e-6), np.asarray(k, float)
    total = theta + mean
    return lgamma(k + theta) - lgamma(theta) - lgamma(k + 1.0) + theta * np.log(theta / total) + k * np.log(mean / total)


def logsumexp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def signal_evidence(count, ambient, prior, mean, theta, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, log odds, expected ambient if signal) of a count that is Poisson background, or that plus a negative
    binomial signal. All splits of a count are summed; counts are taken in blocks of about cells splits."""
    count, ambient, prior, mean, theta = (np.broadcast_to(np.asarray(v, float), np.shape(count)) for v in (count, ambient, prior, mean, theta))
    prior = np.clip(prior, 1e-9, 1 - 1e-9)
    signal, expected = np.empty(len(count)), np.empty(len(count))
    order, at = np.argsort(count, kind="stable"), 0
    while at < len(order):
        # the longest block whose matrix of splits stays in bounds
        width = count[order[at:]] + 1
        n = max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * width, cells, "right")))
        rows = order[at : at + n]
        a = np.arange(int(count[rows].max()) + 1)
        rest = count[rows, None] - a
        terms = np.where(rest >= 0, poisson_logpmf(a, ambient[rows, None]) + negbin_logpmf(np.maximum(rest, 0), mean[rows, None], theta[rows, None]), -np.inf)
        signal[rows] = logsumexp(terms)
        expected[rows] = (np.exp(terms - signal[rows, None]) * a).sum(axis=1)
        at += n
    odds = np.log(prior) + signal - np.log1p(-prior) - poisson_logpmf(count, ambient)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700))), odds, expected


def poisson_upper_tail(k: int, mean: float) -> float:
    """P(X >= k), at least 1e-300."""
    if k <= 0:
        return 1.0
    below = logsumexp(poisson_logpmf(np.arange(k), max(mean, 1e-12)))
    return float(min(1.0, max(1e-300, -math.expm1(min(float(below), 0.0)))))


def empirical_tail(reference: list[float], value: float) -> float:
    """The share of reference values at or over value, uncorrected; 1 without any."""
    return sum(x >= value for x in reference) / len(reference) if reference else 1.0


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    # 1 / (1 + d1 / (1 + d2 / (1 + ...))), from the front
    value, c, d = 1.0, 1.0, 0.0
    for k in range(1, 500):
        m = k // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        c = 1 + term / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front / value


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


def welch(mean1: float, sd1: float, n1: int, mean2: float, sd2: float, n2: int) -> tuple[float, float, float]:
    """(t, degrees of freedom, two-sided p) of sample means with sample sds (n - 1); (0, 0, 1) if nothing varies."""
    if n1 < 2 or n2 < 2:
        return 0.0, 0.0, 1.0
    a, b = sd1 * sd1 / n1, sd2 * sd2 / n2
    if a + b <= 0:
        return 0.0, 0.0, 1.0
    t, df = (mean1 - mean2) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return t, df, t_two_sided(t, df)


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided exact test: P of a or more in the first cell, margins fixed."""
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    row, column, total = a + b, a + c, a + b + c + d
    top = choose(total, column)
    return min(1.0, sum(math.exp(choose(row, k) + choose(total - row, column - k) - top) for k in range(max(a, column - (total - row)), min(row, column) + 1)))


def average_ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    values, first, n = np.unique(x[order], return_index=True, return_counts=True)
    ranks = np.empty(len(x))
    ranks[order] = np.repeat(first + (n + 1) / 2, n)
    return ranks


def pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    """None where a side doesn't vary."""
    x, y = x - x.mean(), y - y.mean()
    d = math.sqrt(float(x @ x) * float(y @ y))
    return float(x @ y) / d if d > 0 else None


def pearson_p(r: float, n: int) -> float:
    return t_two_sided(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2) if n > 2 else 1.0


def spearman(x: np.ndarray, y: np.ndarray) -> float | None:
    return pearson(average_ranks(x), average_ranks(y))


def splitmix64(x: np.ndarray) -> np.ndarray:
    """A step of the public-domain splitmix64 generator on unsigned 64-bit numbers. The constants are fixed values."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a. The constants are fixed values."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h

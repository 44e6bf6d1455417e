"""Numerics on small results: they run on the driver or on a handful of rows."""

from __future__ import annotations

import itertools
import math

import numpy as np

#: Positions up to which none are grouped, and the most ranges behind the first nine.
SINGLES, RANGES = 75, 66


def base_groups(n: int, on: bool = True) -> list[tuple[int, int]]:
    """1-based closed ranges of positions: single ones up to 75 positions or where grouping is off; else nine single ones, then ranges of the
    smallest step of 2, 5, 10, 20, 50, .. of which no more than 66 reach from position 10 to n. The last one is cut at n."""
    if not on or n <= SINGLES:
        return [(i, i) for i in range(1, n + 1)]
    step = next(k for e in itertools.count() for k in (2 * 10**e, 5 * 10**e, 10 * 10**e) if -(-(n - 9) // k) <= RANGES)
    return [(i, i) for i in range(1, 10)] + [(i, min(n, i + step - 1)) for i in range(10, n + 1, step)]


def theoretical_gc(hist: np.ndarray) -> np.ndarray:
    """The normal curve of the histogram's mode and spread, with its total. A flat top moves the mode by half its width."""
    hist = np.asarray(hist, float)
    total = int(hist.sum())
    if total <= 1:
        return np.zeros(len(hist))
    top = int(np.argmax(hist))
    low = hist < 0.9 * hist[top]
    right = top + int(np.argmax(np.append(low[top:], True)))
    left = top - int(np.argmax(np.append(low[: top + 1][::-1], True)))
    mode = top + (right - left - 2) / 2
    at = np.arange(len(hist))
    sd = math.sqrt(((at - mode) ** 2 * hist).sum() / (total - 1))
    if sd == 0:
        return np.where(at == mode, float(total), 0.0)
    curve = np.exp(-((at - mode) ** 2) / (2 * sd * sd))
    return curve * total / curve.sum()


def gc_deviation(hist: np.ndarray) -> float:
    """The sum of absolute differences from the normal curve, in percent of the total."""
    total = float(np.sum(hist))
    return 0.0 if total <= 1 else 100 * float(np.abs(np.asarray(hist) - theoretical_gc(hist)).sum()) / total


def smoothed(values: list[float], width: int = 5) -> list[float]:
    """Moving averages of 1, 2, width, .., width, 2, 1 values."""
    half, n = (width + 1) // 2, len(values)
    if n < width:
        return list(values)
    ends = [sum(values[:w]) / w for w in range(1, half)]
    tail = [sum(values[n - w + 1 :]) / (w - 1) for w in range(half, 1, -1)]
    return ends + [sum(values[i : i + width]) / width for i in range(n - width + 1)] + tail


def poisson_above(k: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """P(X > k) for X of mean mu, k whole; 1 where mu is not positive. The terms of one tail are added up, each from its logarithm: those above k where
    k is at least mu, as they fall from there on, else one less those up to k."""
    k, mu = (np.asarray(x, float) for x in np.broadcast_arrays(k, mu))
    pairs, back = np.unique(np.stack([k.ravel(), mu.ravel()]), axis=1, return_inverse=True)  # many cells share both
    chance = np.array([_above(int(a), m) if m > 0 else 1.0 for a, m in pairs.T.tolist()])
    return chance[back.ravel()].reshape(k.shape) if k.size else np.zeros(k.shape)


def _above(k: int, mu: float) -> float:
    upper = k >= mu
    # beyond some forty standard deviations a term adds nothing
    span = int(40 * math.sqrt(mu) + 60)
    i = np.arange(k + 1, k + 1 + span) if upper else np.arange(max(0, k - span), k + 1)
    first = int(i[0] if upper else i[-1])
    top = first * math.log(mu) - mu - math.lgamma(first + 1)
    # logarithms of the ratios of neighbouring terms, from the largest term on
    ratios = np.log(mu / i[1:]) if upper else np.log(i[:0:-1] / mu)
    total = math.exp(top) * float(np.exp(np.concatenate([[0.0], np.cumsum(ratios)])).sum())
    return min(1.0, total if upper else max(0.0, 1 - total))


def corrected_count(limit: int, n_reads: int, level: int, observed: int) -> float:
    """How many keys of a duplication level there are, where keys were taken up among the first `limit` of n_reads only."""
    if limit == n_reads or n_reads - observed < limit:
        return float(observed)
    # the chance that none of `level` copies is among the first reads: the first copy lies behind them, then the second, and so on
    least = max(1 - observed / (observed + 0.01), 1e-300)
    if level > n_reads - limit or level * math.log1p(-limit / n_reads) < math.log(least):  # no factor is larger than the first
        missed = 0.0
    else:
        missed = math.exp(float(np.log1p(-limit / (n_reads - np.arange(level, dtype=float))).sum()))
    return observed / max(np.finfo(float).eps, 1 - (missed if missed >= least else 0.0))

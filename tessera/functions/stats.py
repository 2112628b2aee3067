"""Closed-form test statistics on aggregated counts: one row or a few, so plain Python on log-gammas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: the tables with the same margins that are no likelier."""
    row, col, n = a + b, a + c, a + b + c + d
    at = lambda k: _log_choose(col, k) + _log_choose(n - col, row - k) - _log_choose(n, row)
    here = at(a)
    return min(1.0, sum(math.exp(at(k)) for k in range(max(0, row + col - n), min(row, col) + 1) if at(k) <= here + 1e-7))


def binomial_sign(k: int, n: int) -> float:
    """Two-sided p of k successes in n fair trials."""
    if n == 0:
        return 1.0
    tail = sum(math.exp(_log_choose(n, i) - n * math.log(2)) for i in range(max(k, n - k), n + 1))
    return min(1.0, 2 * tail)


def poisson_sf(k: int, mean: float) -> float:
    """Chance of at least k events."""
    if k <= 0:
        return 1.0
    return max(0.0, 1.0 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k))) if mean > 0 else 0.0


def fisher_udf(*cols):
    return F.udf(lambda a, b, c, d: round(fisher_exact(int(a), int(b), int(c), int(d)), 9), "double")(*cols)


def sign_udf(*cols):
    return F.udf(lambda k, n: round(binomial_sign(int(k), int(n)), 9), "double")(*cols)


def poisson_udf(*cols):
    return F.udf(lambda k, m: round(poisson_sf(int(k), float(m)), 9), "double")(*cols)

"""What work on all pairs of blocks shares: how many groups to deal rows into, and overlaps of token sets."""

from __future__ import annotations

import math

import numpy as np

#: Rows of a group at most; a small table is cut into smaller groups of at least LEAST.
GROUP, LEAST = 16_384, 256
#: Bytes of a dense slice of token columns.
DENSE = 32 << 20
#: Pairs spelled out at once for tokens that few rows of two blocks hold.
SPELLED = 1 << 22


def group_count(n: int, tasks: int, most: int = GROUP, least: int = LEAST) -> int:
    """Groups of n rows: no more than `most` rows in one, and pairs of them enough for the tasks if there are rows for it."""
    return max(1, -(-n // most), min(-(-n // least), math.ceil(2 * math.sqrt(tasks))))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each row of a has in common with each of b; rows are arrays of distinct numbers.

    Tokens that many rows of both sides hold go through dense slices of columns; of the others each pair is spelled out.
    """
    na, nb = len(a), len(b)
    out = np.zeros((na, nb), np.float32)
    ta, tb = (np.concatenate(x).astype(np.int64) if len(x) else np.empty(0, np.int64) for x in (a, b))
    ra, rb = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    common = np.intersect1d(ta, tb)
    if not len(common):
        return out
    sides = []
    for t, r in ((ta, ra), (tb, rb)):
        ok = np.isin(t, common)
        t, r = np.searchsorted(common, t[ok]), r[ok]
        order = np.argsort(t, kind="stable")
        sides.append((t[order], r[order], np.bincount(t, minlength=len(common))))
    (ta, ra, ca), (tb, rb, cb) = sides
    heavy = ca * cb > 4 * (na + nb)
    width = max(1, DENSE // (4 * (na + nb)))
    columns = np.flatnonzero(heavy)
    for at in range(0, len(columns), width):
        place = np.full(len(common), -1)
        place[columns[at : at + width]] = np.arange(len(columns[at : at + width]))
        x, y = (np.zeros((n, min(width, len(columns) - at)), np.float32) for n in (na, nb))
        for m, t, r in ((x, ta, ra), (y, tb, rb)):
            ok = place[t] >= 0
            m[r[ok], place[t[ok]]] = 1
        out += x @ y.T
    light = ~heavy[ta]
    t, r = ta[light], ra[light]
    times, first = cb[t], np.concatenate(([0], np.cumsum(cb)))[t]
    ends = np.cumsum(times)
    at = 0
    while at < len(t):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPELLED, side="right")))
        n = times[at:to]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(r[at:to], n) * nb + rb[np.repeat(first[at:to], n) + step]
        out += np.bincount(cell, minlength=na * nb).reshape(na, nb)
        at = to
    return out

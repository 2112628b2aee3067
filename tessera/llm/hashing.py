"""Vectorised hashing of words and of word windows.

Words are the runs between ASCII white space (\\x20, \\x09-\\x0D) of a UTF-8 text. Fingerprints are 64-bit.
Memory is bounded by the slice, not by the text: a slice of about a quarter of a megabyte ends at white space.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash

SLICE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BREAK = re.compile(rb"\n")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.cache
def _letters(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(0x51ED270B))


def _slices(data: bytes, gap_: re.Pattern = _GAP):
    at = 0
    while at < len(data):
        if len(data) - at <= SLICE:
            yield at, data[at:]
            return
        gap = gap_.search(data, at + SLICE)
        to = gap.end() if gap else len(data)
        yield at, data[at:to]
        at = to


def words(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 fingerprint, first byte and end byte of each word of data."""
    found = []
    for at, part in _slices(data):
        b = np.frombuffer(part, np.uint8)
        ink = np.zeros(len(b) + 2, np.int8)
        ink[1:-1] = ~_SPACE[b]
        turn = np.diff(ink)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        if not len(start):
            continue
        up, down = _powers(1 << max(19, (len(b) + 1).bit_length()))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_letters(lower)[b] * up[: len(b)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        found.append((mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), start + at, end + at))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def lines(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """uint64 fingerprint and characters of each line of data, without the white space around it; a blank line has 0 and 0."""
    found = []
    for at, part in _slices(data, _BREAK):
        b = np.frombuffer(part, np.uint8)
        ends = np.flatnonzero(b == 10)
        if at + len(b) == len(data):
            ends = np.append(ends, len(b))
        ink = np.flatnonzero(~_SPACE[b])
        lo = np.searchsorted(ink, np.append(0, ends[:-1] + 1))
        hi = np.searchsorted(ink, ends)
        some = lo < hi
        start, end = ink[lo[some]], ink[hi[some] - 1] + 1
        letters = np.append(0, np.cumsum((b & 0xC0) != 0x80))
        h, size = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.int64)
        size[some] = letters[end] - letters[start]
        if len(start) and int((end - start).max()) > SLICE:  # powers up to the length of such a line would cost more than it
            places = zip(start.tolist(), end.tolist(), strict=True)
            h[some] = [xxhash.xxh3_64_intdigest(part[s:e]) or 1 if e - s > SLICE else _one_line(part[s:e]) for s, e in places]
        elif len(start):
            h[some] = _spans(b, start, end)
        found.append((h, size))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spans(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints, never 0, of the bytes between start and end."""
    up, down = _powers(1 << max(19, (len(b) + 1).bit_length()))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_letters(False)[b] * up[: len(b)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return np.maximum(mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), np.uint64(1))


def _one_line(data: bytes) -> int:
    return int(_spans(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def runs(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs of items between start and end; one item is its own."""
    n = len(hashes)
    up, down = _powers(1 << max(12, (n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    many = mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.where(end - start == 1, hashes[start], many)


def windows(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Fingerprint of each run of `width` items."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x2545F4914F6CDD1D + salt, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + mix(hashes[k : k + n] + np.uint64(k + 1))
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digest(x: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit fingerprints of an array of uint64."""
    if not len(x):
        return 0, 0
    k = np.arange(1, len(x) + 1, dtype=np.uint64)
    a = mix(x ^ (k * np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64)
    b = mix((x + np.uint64(0x632BE59BD9B4E019)) * (k + k + np.uint64(1))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))

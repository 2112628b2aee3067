"""Burrows-Wheeler transforms of sets of byte strings, and their merge by interleave refinement.

Each string ends with a terminator (0; bytes are raised by one, which UTF-8 leaves room for). A shard's
transform comes from sorting its own suffixes. Shards are merged without sorting suffixes again (Holt and
McMillan, 2014): an interleave says which shard each row of the merged transform comes from. Reading the
transforms in the order of one interleave and dealing rows out by symbol, stably, gives the interleave that
is right for one more symbol. Blocks of rows that agree on the symbols so far are refined alongside; the
round in which a boundary appears is the common prefix with the row before, plus one. Once most rows stand alone
in their blocks they are settled, and further rounds refine the others only: a block parts where the blocks of its
rows' successors, one symbol on, differ.
"""

from __future__ import annotations

import numpy as np

#: Dealing all rows out ends when no more than one in SETTLED shares its block.
SETTLED = 2


def shard(strings: list[bytes], depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Transform (uint8) and the rows' places in the concatenation of the terminated strings.

    Suffixes are ranked by their first 8 symbols, then by twice as many each round; equal suffixes of
    different strings keep the strings' order. With depth, the order is right for that many symbols at least.
    """
    text = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)  # 0xff ends a string and becomes 0
    n, longest = len(text), min(max(map(len, strings)) + 1, depth or len(text))
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) + 1  # symbols to the terminator, it included
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.where(left > k, wide[k : n + k], 0).astype(np.uint64)
    h = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        if h >= longest or rank[order[-1]] == n:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:]
        ahead[left <= h] = 0
        key = (rank << 32 | ahead).astype(np.uint64)
        h *= 2
    order = np.argsort(rank << 32 | np.arange(n))
    return text[order - 1], order


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order, as indices into the concatenated transforms, and the common prefix of each row with the one before.

    The order is right for `depth` symbols, and prefixes are counted up to depth. Rows of a terminator
    alone share nothing with each other. Within a shard the row dealt for a symbol is the one that the
    shard's own counting of symbols (its last-to-first map) gives, so rows are kept, and owners follow.
    """
    symbols = np.concatenate(transforms)
    n = len(symbols)
    base = np.cumsum([0, *map(len, transforms)])[:-1]
    first = np.empty(n, np.int32)
    heads = []
    for b, t in zip(base, transforms, strict=True):
        first[b + np.argsort(t, kind="stable")] = np.arange(b, b + len(t))
        heads.append(np.arange(b, b + int((t == 0).sum())))
    heads = np.concatenate(heads).astype(np.int32)
    ended = len(heads)
    rows = np.arange(n, dtype=np.int32)  # the merged order so far
    block = np.zeros(n, np.int32)
    prefix = np.full(n, -1, np.int16 if depth < 1 << 15 else np.int32)
    prefix[0] = 0
    edge = np.empty(n, bool)
    edge[:ended] = True
    h = 0
    while h < depth:
        h += 1
        c = symbols[rows]
        dealt = np.argsort(c, kind="stable")[ended:]
        rows = np.concatenate([heads, first[rows[dealt]]])
        c, old = c[dealt], block[dealt]
        edge[ended : ended + 1] = True
        edge[ended + 1 :] = (c[1:] != c[:-1]) | (old[1:] != old[:-1])
        prefix[edge & (prefix < 0)] = h - 1
        block = np.cumsum(edge, dtype=np.int32)
        alone = np.count_nonzero(edge[:-1] & edge[1:])
        if alone * SETTLED > n * (SETTLED - 1):
            break
    if h < depth:
        _settle(rows, prefix, edge, first, symbols, h, depth)
    prefix[prefix < 0] = depth
    return rows, prefix


def _settle(rows: np.ndarray, prefix: np.ndarray, edge: np.ndarray, first: np.ndarray, symbols: np.ndarray, h: int, depth: int) -> None:
    """Goes on from round h with blocks of several rows only; rows and prefix are brought up to date in place.

    A block can part in a round only if a successor of its rows got another block in the round before.
    """
    n = len(rows)
    after = np.zeros(n, np.int32)
    inner = np.flatnonzero(symbols)
    after[first[inner]] = inner  # the row of the suffix one symbol on
    starts = np.flatnonzero(edge)
    size = np.zeros(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    head = np.repeat(starts, size[starts])  # of each place, where its block starts
    of_row, place = np.empty(n, np.int64), np.empty(n, np.int64)
    of_row[rows], place[rows] = head, np.arange(n)
    some = np.flatnonzero(~(edge & np.append(edge[1:], True)))
    while len(some) and h < depth:
        h += 1
        r, block = rows[some], head[some]
        key = block << 32 | of_row[after[r]]
        order = np.argsort(key, kind="stable")
        key, r = key[order], r[order]
        new = np.append(True, key[1:] != key[:-1])
        cut = np.flatnonzero(new)
        at = some[cut]
        size[at] = np.diff(np.append(cut, len(some)))
        now = np.repeat(at, size[at])
        prefix[at[block[cut] != at]] = h - 1
        rows[some], place[r], head[some], of_row[r] = r, some, now, now
        moved = r[now != block]
        blocks = np.unique(head[place[first[moved[symbols[moved] != 0]]]])
        blocks = blocks[size[blocks] > 1]
        length = size[blocks]
        some = np.repeat(blocks - np.cumsum(length) + length, length) + np.arange(length.sum())


def repeats(strings: list[bytes], depth: int, weights: np.ndarray | None = None, shard_bytes: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and group of each suffix whose first `depth` bytes occur more than once; a string occurs as often as its weight says."""
    parts, lot, size = [], [], 0
    for s in strings:
        lot.append(s)
        size += len(s) + 1
        if size >= shard_bytes:
            parts.append(lot)
            lot, size = [], 0
    if lot:
        parts.append(lot)
    transforms, places, base = [], [], 0
    for p in parts:
        t, order = shard(p, depth)
        transforms.append(t)
        places.append(order + base)
        base += len(order)
    rows, prefix = merge(transforms, depth)
    place = np.concatenate(places)[rows]
    group = np.cumsum(prefix < depth)
    length = np.array([len(s) + 1 for s in strings])
    first = np.cumsum(length) - length
    # places that a whole window starts at; what is shorter shares no window
    left = np.repeat(first + length, length) - np.arange(base)
    which = np.repeat(np.arange(len(strings)), length)
    size = np.bincount(group, weights=None if weights is None else weights[which[place]])
    keep = (size[group] > 1) & (left[place] > depth)
    place, group = place[keep], group[keep]
    which = which[place]
    return which, place - first[which], group

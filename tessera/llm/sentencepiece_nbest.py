"""SentencePiece encoding and decoding by N-best segmentation over the piece lattice.

Forward Viterbi gives the best score from the start to each place; read backward, that is the exact cost
still to go. The segmentations, the best one included, come from an A* search backward from the end. As the
heuristic is exact, a path that follows the best arcs loses nothing and needs no queue: the queue holds only the
turns away from them, with what each loses, and is kept to the N cheapest. Every hypothesis that leaves it is
one of the N best, in order.

No piece of the model crosses from other characters into a space mark, so a text's lattice falls apart into
words, each with its marks in front, and further wherever no piece holds the two characters next to each
other. The forward pass runs once over the distinct words of many texts. The search over each gives its best
segmentation and what its second best loses. In a text's N best only the N - 1 words with the least such losses
can differ from their best; those are searched for their N best, and the cheapest combinations of their choices
are the text's N best.

Pieces score as the model has them. Characters without a piece fall back to byte pieces, at the penalty of
UNKNOWN for each byte. Of equal arcs the shorter piece comes first.

Defined results: null text is null and encodes to nothing; empty text to an empty list, which decodes to
empty text; repeated rows are encoded alike; a word of any length is searched whole, in memory that grows with its
length; other columns are ignored, but for those asked for, unless they are named like a result. Decoding gives the
text back byte for byte: only the mark U+2581 itself, which the model can't tell from a space, goes through byte
pieces.
"""

from __future__ import annotations

import functools
import gc
import heapq
import itertools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: The mark as a character of the text; no text holds a lone surrogate.
LITERAL = "\ud800"
N_BEST = 4
#: Added to the lowest score of the model for a byte piece.
UNKNOWN = -10.0
#: Words that a worker keeps with their N best segmentations; words of up to SHORT characters that it keeps with their best.
CACHE, KNOWN, SHORT = 1 << 15, 1 << 18, 16
#: Words over so many characters are looked at for places that no piece crosses, and don't share the forward pass of others.
LONG = 64
#: Texts encoded together, whose distinct words are segmented once.
LOT = 4096


@dataclass(frozen=True)
class Best:
    score: float
    ids: tuple[int, ...]


class Lattice:
    """Pieces with scores, and the searches over a word's lattice."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[tuple[int, float]]):
        self.pieces, self.bytes_ = pieces, bytes_
        self.widest = max(map(len, pieces), default=1)
        spelled = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, (i, _) in enumerate(bytes_)}
        self.spelling = np.full(max(spelled) + 1, b"", object)
        for i, b in spelled.items():
            self.spelling[i] = b
        # pieces spelled backward, as a trie: character -> (further characters, id or -1, score)
        self.reversed_: dict = {}
        for piece, (i, more) in pieces.items():
            node = self.reversed_
            for c in piece[:0:-1]:
                node = node.setdefault(c, ({}, -1, 0.0))[0]
            node[piece[0]] = (node.get(piece[0], ({},))[0], i, more)
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.n_best = functools.lru_cache(CACHE)(self._n_best)
        self.known: dict[str, tuple[float, float, tuple[int, ...]]] = {}
        self.before: dict[str, tuple[float, float, tuple[int, ...]]] = {}

    @classmethod
    def load(cls, path: str | None = None) -> Lattice:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        pieces, bytes_ = {}, [(0, 0.0)] * 256
        for i in range(model.vocab_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_[int(name[3:5], 16)] = (i, 0.0)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[name] = (i, model.get_score(i))
        low = min(s for _, s in pieces.values()) + UNKNOWN
        return cls({p: x for p, x in pieces.items() if MARK not in p.lstrip(MARK)}, [(i, low) for i, _ in bytes_])

    def arcs(self, word: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The arcs that end at a place: (start, score, ids), shortest first."""
        out = [] if word[end - 1] in self.pieces else [self.raw(word[end - 1], end)]
        node, start = self.reversed_, end - 1
        while start >= 0:
            found = node.get(word[start])
            if found is None:
                break
            node, piece, more = found
            if piece >= 0:
                out.append((start, more, (piece,)))
            start -= 1
        return out

    def raw(self, char: str, end: int) -> tuple[int, float, tuple[int, ...]]:
        """The arc of a character's byte pieces."""
        data = MARK.encode() if char == LITERAL else char.encode("utf-8", "replace")
        return end - 1, sum(self.bytes_[b][1] for b in data), tuple(self.bytes_[b][0] for b in data)

    def scores(self, word: str) -> tuple[array, array]:
        """Forward Viterbi over one word: the best score up to each place, and what the second best arc there loses."""
        best, gap = array("d", [0.0]), array("d", [float("inf")])
        for end in range(1, len(word) + 1):
            two = heapq.nlargest(2, (best[start] + more for start, more, _ in self.arcs(word, end)))
            best.append(two[0])
            gap.append(two[0] - two[-1] if len(two) > 1 else float("inf"))
        return best, gap

    def search(self, word: str, best, n: int) -> list[Best]:
        """The n best segmentations by backward A*. An entry of the queue is a turn: (loss of the whole, serial, place it leads to, ids from there to the end)."""
        queue, serial, out, limit = [(0.0, 0, len(word), None)], 0, [], float("inf")
        while queue and len(out) < n:
            loss, _, place, path = heapq.heappop(queue)
            while place:  # follow the best arcs, and note the turns away from them
                arcs = self.arcs(word, place)
                top, most = 0, float("-inf")
                for k, (start, more, _) in enumerate(arcs):
                    if best[start] + more > most:
                        top, most = k, best[start] + more
                for k, (start, more, ids) in enumerate(arcs):
                    turn = loss + (most - best[start] - more)
                    if k != top and turn <= limit:
                        serial += 1
                        heapq.heappush(queue, (turn, serial, start, (ids, path)))
                if len(queue) > 8 * n:
                    queue = heapq.nsmallest(n - len(out), queue)  # sorted, hence a heap
                    limit = queue[-1][0]
                place, path = arcs[top][0], (arcs[top][2], path)
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            out.append(Best(best[-1] - loss, tuple(ids)))
        return out

    def first(self, word: str, best, gap) -> tuple[list[int], float]:
        """The same search for the best segmentation alone: ids, and the least loss of the turns, which is the second best's."""
        root, pieces = self.reversed_, self.pieces
        ids, second, place = [], float("inf"), len(word)
        while place:
            if gap[place] < second:
                second = gap[place]
            goal, node, start = best[place], root, place - 1
            if word[start] not in pieces:
                start, more, raw = self.raw(word[start], place)
                if best[start] + more == goal:
                    ids.extend(reversed(raw))
                    place = start
                    continue
            while True:
                node, piece, more = node[word[start]]
                if piece >= 0 and best[start] + more == goal:
                    break
                start -= 1
            ids.append(piece)
            place = start
        ids.reverse()
        return ids, second

    def _n_best(self, word: str, n: int) -> tuple[Best, ...]:
        return tuple(self.search(word, self.scores(word)[0], n))

    def words(self, text: str) -> list[str]:
        """The text's words with their marks in front; long ones are parted where no piece crosses."""
        parts = text.replace(MARK, LITERAL).split(" ")
        if "" not in parts and max(map(len, parts)) < LONG:
            return [parts[0], *(MARK + p for p in parts[1:])]
        out, marks = [], 0
        for k, p in enumerate(parts):
            marks += k > 0
            if p or k == len(parts) - 1:
                word = MARK * marks + p
                marks = 0
                at = 0
                if len(word) > LONG:
                    for i in range(1, len(word)):
                        if word[i - 1 : i + 1] not in self.joined:
                            out.append(word[at:i])
                            at = i
                if word:
                    out.append(word[at:])
        return out

    def forward(self, words: list[str]) -> Iterator[tuple[list[float], list[float]]]:
        """Viterbi over many words: of each, the best score up to each place, and what the second best arc there loses.

        words are sorted, so each goes on from the prefix that it shares with the one before; what is yielded holds until the next one.
        """
        one, gap, before, low = [0.0], [float("inf")], "", float("-inf")
        root, pieces = self.reversed_, self.pieces
        for w in words:
            if len(w) > LONG:
                yield self.scores(w)
                continue
            m = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                m += 1
            del one[m + 1 :], gap[m + 1 :]
            for end in range(m, len(w)):
                best = second = low
                node, start = root, end
                if w[end] not in pieces:
                    _, more, _ = self.raw(w[end], end + 1)
                    best = one[end] + more
                while start >= 0:
                    found = node.get(w[start])
                    if found is None:
                        break
                    node, piece, more = found
                    if piece >= 0:
                        v = one[start] + more
                        if v > best:
                            best, second = v, best
                        elif v > second:
                            second = v
                    start -= 1
                one.append(best)
                gap.append(best - second)
            yield one, gap
            before = w

    def best_of(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words numbered from 0: best score, loss of the second best, ids one after another, and the number of each word's ids."""
        if len(self.known) >= KNOWN:  # words that are met again stay for one more time
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = [known.get(w) or before.get(w) for w in words]
        new = sorted(w for w, x in zip(words, found, strict=True) if x is None)
        for w, (one, gap) in zip(new, self.forward(new), strict=True):
            ids, second = self.first(w, one, gap)
            found[words[w]] = x = one[-1], second, tuple(ids)
            if len(w) <= SHORT:
                known[w] = x
        if before:
            known.update((w, x) for w, x in zip(words, found, strict=True) if w in before)
        flat = np.fromiter(itertools.chain.from_iterable(x[2] for x in found), np.int64)
        score, loss = (np.fromiter((x[k] for x in found), np.float64, len(found)) for k in (0, 1))
        return score, loss, flat, np.fromiter((len(x[2]) for x in found), np.int64, len(found))

    def encode_batch(self, texts: list[str | None], n: int = N_BEST) -> list[list[tuple[float, np.ndarray]] | None]:
        """Of each text, its n best segmentations: score and ids."""
        seen: dict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        coded = [None if t is None else np.fromiter(map(seen.__getitem__, self.words(t)), np.int64) for t in texts]
        score, loss, flat, size = self.best_of(seen)
        names, ends = list(seen), np.cumsum(size)
        out: list = []
        for c in coded:
            if c is None:
                out.append(None)
                continue
            before = np.append(0, np.cumsum(size[c]))  # of each word, the ids of the text before it
            ids = flat[np.repeat(ends[c] - size[c] - before[:-1], size[c]) + np.arange(before[-1])]
            losses = loss[c]
            # only the n - 1 words with the least first losses can differ from their best
            some = np.argpartition(losses, n - 2)[: n - 1] if len(c) > n - 1 > 0 else np.arange(len(c) if n > 1 else 0)
            some = np.sort(some[np.isfinite(losses[some])]).tolist()
            lists = [self.n_best(names[c[k]], n) for k in some]
            top, found = float(score[c].sum()), []
            for less, picks in _cheapest([[x[0].score - b.score for b in x] for x in lists], n):
                parts, at = [], 0
                for k, x, r in zip(some, lists, picks, strict=True):
                    if r:
                        parts += [ids[at : before[k]], np.array(x[r].ids, np.int64)]
                        at = before[k + 1]
                found.append((top - less, np.concatenate([*parts, ids[at:]]) if parts else ids))
            out.append(found)
        return out

    def encode(self, text: str, n: int = N_BEST) -> list[Best]:
        """The n best segmentations of the text, best first."""
        lists = [self.n_best(w, n) for w in self.words(text)]
        top = sum(x[0].score for x in lists)
        out = []
        for loss, picks in _cheapest([[x[0].score - b.score for b in x] for x in lists], n):
            out.append(Best(top - loss, tuple(i for x, r in zip(lists, picks, strict=True) for i in x[r].ids)))
        return out

    def decode(self, ids) -> str:
        """Text of the ids: what pieces spell, marks as spaces, byte pieces as their bytes."""
        return self.spell(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(self.spelling[ids].tolist())


def _cheapest(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n cheapest ways to take one of each list (lists rise from 0), with what is taken of each."""
    chosen = [(0.0, ())]
    for options in losses:
        chosen = heapq.nsmallest(n, ((loss + more, (*picks, r)) for loss, picks in chosen for r, more in enumerate(options)))
    return chosen


@functools.cache
def lattice(path: str | None = None) -> Lattice:
    return Lattice.load(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, keep: list[str], n: int = N_BEST, path: str | None = None, ids: bool = True) -> DataFrame:
    """Columns `keep` of docs with the n best segmentations, best first.

    n_pieces and ids_crc32 of the best, scores and crc32 of each, decoded (whether the ids of the best give the text
    back), and the ids of each themselves if asked for.
    """

    def run(text: list) -> list[list]:
        model, out = lattice(path), [[] for _ in range(6)]
        gc.disable()  # nothing here refers to itself, and to look through the words kept takes a tenth of the time
        for at in range(0, len(text), LOT):
            part = text[at : at + LOT]
            for t, found in zip(part, model.encode_batch(part, n), strict=True):
                if found is None:
                    row = (0, None, [], [], None, [])
                else:
                    sums = [_crc(x) for _, x in found]
                    fine = model.spell(found[0][1]) == t.encode("utf-8", "replace")
                    row = (len(found[0][1]), sums[0], [s for s, _ in found], sums, fine, [x for _, x in found])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        gc.enable()
        return out if ids else out[:5]

    added = "n_pieces long, ids_crc32 long, scores array<double>, crc32 array<long>, decoded boolean" + ", ids array<array<long>>" * ids
    return common.with_columns_by(docs, keep, {"text": F.col("text")}, run, added, replace=True)


def decoded(rows: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """Columns `keep` of rows (ids array<long>) with text."""

    def run(ids: list) -> list[list]:
        model = lattice(path)
        return [[None if x is None else model.decode(x) for x in ids]]

    return common.with_columns_by(rows, keep, {"ids": F.col("ids")}, run, "text string")


def op6_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"), ["doc_id"], ids=False)

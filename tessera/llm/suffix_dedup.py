"""Suffix-array dedup: repeated byte strings found in merged Burrows-Wheeler transforms.

Every byte covered by a `width`-byte string that also starts earlier is removed (earlier: in a smaller
doc_id, or further ahead in the same document). superkmers.py brings the strings that may repeat together;
each bucket builds the transforms of its shards, merges them by interleave refinement, and reads the
repeated intervals, those of rows with a common prefix of at least `width`, off the merged transform.

Copies of one super-k-mer (equal minimisers and 64-bit fingerprints of their contents) enter the transform as one
string that counts as often as it occurs; what the transform finds repeated in it holds for each copy, and for the
first one where an earlier string of the bucket holds the window.

Defined results: null text is empty; texts shorter than width lose nothing; rows that repeat a doc_id count
as one document, and what they hold at the same place starts once; a null doc_id comes before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, common, superkmers
from .hashing import _powers, mix

WIDTH = 100
#: Bytes of a minimiser, but for narrow windows.
GRAM = 25
#: Slices of a minimiser's places within a window; the windows of a slice share a core of bytes around it.
SLICES = 4

_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _units(text: str | None) -> tuple[np.ndarray, int, str]:
    data = _data(text)
    return _BYTES[np.frombuffer(data, np.uint8)], len(data), hashlib.sha256(data).hexdigest()


def _cut(text: str | None, starts: list[int], ends: list[int]) -> list[bytes]:
    data = _data(text)
    return [data[s:e] for s, e in zip(starts, ends, strict=True)]


def trimmed(pdf: pd.DataFrame, width: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The parts of the strings whose windows may repeat, with their string and place there.

    The windows of a super-k-mer that hold its minimiser at nearly the same place share a core of bytes
    around it. Windows whose core no other string of the minimiser has can't repeat, and stay out.
    """
    strings = pdf["string"].tolist()
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = pdf["string"].map(len).to_numpy()
    first, k = np.cumsum(size) - size, size - width + 1
    spot, mh = pdf["spot"].to_numpy().astype(np.int64), pdf["mh"].to_numpy().view(np.uint64)
    often = pdf["copies"].to_numpy() > 1
    up, down = _powers(1 << max(12, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    which, lo, hi = [], [], []
    span = width - gram + 1
    edges = [span * i // SLICES for i in range(SLICES + 1)]
    for a, b in zip(edges, edges[1:], strict=False):
        b -= 1
        some = np.flatnonzero((spot >= a) & (spot - b < k))
        s = first[some] + spot[some] - a
        e = s + a - b + width
        core = mix((total[e] - total[s]) * down[s] + mix(mh[some]))
        _, same, n = np.unique(core, return_inverse=True, return_counts=True)
        some = some[(n[same] > 1) | often[some]]
        which.append(some)
        lo.append(np.maximum(0, spot[some] - b))
        hi.append(np.minimum(k[some], spot[some] - a + 1))
    which, lo, hi = np.concatenate(which), np.concatenate(lo), np.concatenate(hi)
    order = np.lexsort((lo, which))
    which, lo, hi = which[order], lo[order], hi[order]
    if not len(which):
        return [], which, lo
    new = np.append(True, (which[1:] != which[:-1]) | (lo[1:] != hi[:-1]))
    at = np.flatnonzero(new)
    end = hi[np.append(at[1:], len(hi)) - 1]
    parts = [strings[i][a : b + width - 1] for i, a, b in zip(which[at].tolist(), lo[at].tolist(), end.tolist(), strict=True)]
    return parts, which[at], lo[at]


def _bucket(width: int, gram: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of each string of the bucket: runs that go from all copies, and those (first) that go from the first copy."""
    pdf = pdf.reset_index(drop=True)
    parts, string, place = trimmed(pdf, width, gram)
    names = ["mh", "ch", "s", "e", "first"]
    if not parts:
        return pd.DataFrame([], columns=names)
    copies = pdf["copies"].to_numpy()
    which, off, group = bwt.repeats(parts, width, copies[string])
    which, off = string[which], off + place[which]
    later = np.zeros(len(which), bool)
    some = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)  # only these stand behind another string's window
    where = pdf["start"].to_numpy()[which[some]] + off[some]
    order = some[np.lexsort((where, pdf["rid"].to_numpy()[which[some]], group[some]))]
    later[order[1:]] = group[order[1:]] == group[order[:-1]]
    mh, ch, base = pdf["mh"].to_numpy(), pdf["ch"].to_numpy(), pdf["off"].to_numpy()
    rows = []
    for first, keep in ((False, copies[which] > 1), (True, later)):
        # windows by string and place, cut into runs that overlap
        place_ = np.sort(which[keep] << 32 | off[keep])
        w, o = place_ >> 32, place_ & 0xFFFF_FFFF
        if not len(w):
            continue
        head = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (o[1:] - o[:-1] > width)))
        tail = np.append(head[1:], len(w)) - 1
        i = w[head]
        rows.append(pd.DataFrame({"mh": mh[i], "ch": ch[i], "s": o[head] + base[i], "e": o[tail] + width + base[i], "first": first}))
    return pd.concat(rows) if rows else pd.DataFrame([], columns=names)


def repeated_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    gram = min(GRAM, max(1, width // 4))
    marks = superkmers.marked(docs, _units, width, gram)
    found = superkmers.survivors(marks)
    kinds = superkmers.classes(found)
    rows = superkmers.strings(docs, marks, kinds.filter("contents > 1 OR copies > 1"), _cut, width, 1)
    inner = common.written(rows.groupBy("bucket").applyInPandas(_by_bucket(width, gram), "mh long, ch long, s long, e long, first boolean"))
    common.released(docs.sparkSession)
    start, _, _ = superkmers.places()
    many = kinds.filter("copies > 1").select("mh", "ch", F.col("first.rid").alias("rid0"), F.col("first.start").alias("start0"))
    # written first, so that a content with very many copies can be split in the join
    many = common.written(many.join(inner.filter("NOT first"), ["mh", "ch"]))
    others = found.join(many, ["mh", "ch"]).filter((F.col("rid") != F.col("rid0")) | (start != F.col("start0")))
    copies = others.select("uid", (F.col("s") + start).alias("s"), (F.col("e") + start).alias("e"))
    firsts = inner.filter("first").join(kinds.select("mh", "ch", "first.uid", "first.start"), ["mh", "ch"]).select("uid", (F.col("s") + F.col("start")).alias("s"), (F.col("e") + F.col("start")).alias("e"))

    def keep(text: str | None, spans: list) -> tuple[int, int, str]:
        data = np.frombuffer(_data(text), np.uint8)
        gone = superkmers.covered(len(data), spans)
        return int(gone.sum()), int(np.diff(gone.astype(np.int8), prepend=0).clip(0).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()

    cut = common.written(superkmers.with_spans(docs, marks, copies.union(firsts), keep, "n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["rid", "mark"]))
    common.released(docs.sparkSession)
    out = marks.join(cut, ["rid", "mark"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def _by_bucket(width: int, gram: int):
    return lambda pdf: _bucket(width, gram, pdf)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(common.table(spark, sf_dir, "documents"))

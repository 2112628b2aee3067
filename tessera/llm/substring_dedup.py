"""Substring dedup by super-k-mer partitioning: word windows that occur more than once go.

Consecutive windows that share a minimiser travel as one packed string to its bucket (superkmers.py). There
the strings are taken apart into windows, and sorting the windows counts them exactly, word for word.

Defined results: null text has no words; documents shorter than a window lose nothing; a row that repeats a
doc_id with the same text is another place where its windows start; a null doc_id is a document like any
other; an empty table gives an empty result; other columns are ignored. All copies go, the first included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, superkmers
from .hashing import words

WIDTH = 35
GRAM = 8


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _units(text: str | None) -> tuple[np.ndarray, int, str]:
    data = _data(text)
    values, _, _ = words(data, lower=False)
    return values, len(values), hashlib.sha256(b" ".join(data.split())).hexdigest()


def _cut(text: str | None, starts: list[int], ends: list[int]) -> list[bytes]:
    parts = _data(text).split()
    return [b" ".join(parts[s:e]) for s, e in zip(starts, ends, strict=True)]


def _bucket(width: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of each class in the bucket: a row (mh, ch, s, e) for each run of them."""
    strings = [s.split(b" ") for s in pdf["string"]]
    flat = [w for s in strings for w in s]
    code = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter((code[w] for w in flat), np.uint32, len(flat))
    length = np.array([len(s) for s in strings])
    first = np.cumsum(length) - length
    n = length - width + 1
    which = np.repeat(np.arange(len(strings)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[which] + off
    view = np.lib.stride_tricks.sliding_window_view(ids, width)
    packed = np.ascontiguousarray(view[at].astype(">u4")).view(f"V{4 * width}").ravel()
    order = np.argsort(packed, kind="stable")
    ordered = packed[order]
    group = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])) if len(order) else order
    copies = np.bincount(group, weights=pdf["copies"].to_numpy()[which[order]]) if len(order) else np.empty(0)
    often = np.zeros(len(at), bool)
    often[order] = copies[group] > 1
    rows = []
    mh, ch, base = pdf["mh"].to_numpy(), pdf["ch"].to_numpy(), pdf["off"].to_numpy()
    ends = np.cumsum(n)
    for i in np.unique(which[often]):
        for r in superkmers.ranges(often[ends[i] - n[i] : ends[i]], width):
            rows.append((mh[i], ch[i], r["s"] + base[i], r["e"] + base[i]))
    return pd.DataFrame(rows, columns=["mh", "ch", "s", "e"])


def _by_bucket(width: int):
    return lambda pdf: _bucket(width, pdf)


def repeated_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 of each row."""
    gram = min(GRAM, max(1, width // 3))
    marks = superkmers.marked(docs, _units, width, gram)
    found = superkmers.survivors(marks)
    kinds = superkmers.classes(found)
    rows = superkmers.strings(docs, marks, kinds, _cut, width, 7)
    inner = common.written(rows.groupBy("bucket").applyInPandas(_by_bucket(width), "mh long, ch long, s long, e long"))
    common.released(docs.sparkSession)
    start, _, _ = superkmers.places()
    spans = found.join(inner, ["mh", "ch"]).select("uid", (start + F.col("s")).alias("s"), (start + F.col("e")).alias("e"))

    def keep(text: str | None, spans: list) -> tuple[int, str]:
        parts = _data(text).split()
        gone = superkmers.covered(len(parts), spans)
        return int(gone.sum()), hashlib.sha256(b" ".join(p for p, g in zip(parts, gone, strict=True) if not g)).hexdigest()

    cut = common.written(superkmers.with_spans(docs, marks, spans, keep, "n_removed long, kept_sha256 string").dropDuplicates(["rid", "mark"]))
    common.released(docs.sparkSession)
    out = marks.join(cut, ["rid", "mark"], "left")
    return out.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(common.table(spark, sf_dir, "documents"))

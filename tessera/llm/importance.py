"""Importance resampling towards a target distribution, by hashed n-gram features.

Two passes over the texts, both on Arrow batches:

1. Every partition counts its features' buckets into one vector of BUCKETS numbers (np.bincount), and a treeReduce adds
   the vectors up; so are the target's texts counted. A bucket's gain is the logarithm of its share in the target over
   its share in the documents, both smoothed by one.
2. The gains, a vector of BUCKETS numbers whatever the data, are broadcast, gathered for each feature and summed by
   document (np.bincount with weights).

A score adds Gumbel noise, drawn from a hash of doc_id, to a document's mean gain; the highest scores are then a draw
without replacement in proportion to the importance weights. Ranks come from sorted runs and their counts
(`common.in_order`), not from a window over all rows.

A batch's texts lie in one buffer, which is walked in slices that end between words, so memory is bounded by the
batch; only a single word has to fit in whole.

Defined results: a null or text without words has no feature, weight 0, and is never drawn. Repeated rows are scored
and drawn each; ties of score go to the smaller doc_id, then to fewer features; a null doc_id is hashed as empty text
and comes last in ties. Empty tables give empty results, an empty target counts as T = 0. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
#: Bytes of a slice, but for a longer word.
SLICE = 1 << 20
#: Words of at most so many bytes go through the table together; longer ones are hashed alone.
TOGETHER = 40
LEAST_WORDS = 20
#: Parts of a hundred that are drawn.
PERCENT = 25
SEED = 7


@functools.cache
def _crc_table() -> np.ndarray:
    """The step of CRC-32 for each byte (the reflected polynomial of IEEE 802.3)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


@functools.cache
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """A byte's lower case, and whether it belongs to a word: digits, ASCII letters, all bytes of other characters."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    ink = np.arange(256) >= 128
    ink[48:58] = ink[97:123] = ink[65:91] = True
    return low, ink


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _crc_table()[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _run(state: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after the words b[start:start + size], each from its own state."""
    state = state.copy()
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -TOGETHER))
    for i in order[:long]:
        # zlib inverts the state before and after
        state[i] = zlib.crc32(b[start[i] : start[i] + size[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[long:]
    s, at, left = state[order], start[order], -size[order]
    for k in range(int(-left[0]) if len(order) else 0):
        m = int(np.searchsorted(left, -k))  # words longer than k bytes come first
        s[:m] = _step(s[:m], b[at[:m] + k])
    state[order] = s
    return state


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of binary without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice: the row and the bucket of each feature (words, and pairs of neighbouring words)."""
    data, offsets = _buffers(column)
    low, ink = _folded()
    at, end = int(offsets[0]), int(offsets[-1])
    carried = None  # the last word's row and its state with a space behind it
    while at < end:
        to = min(at + SLICE, end)
        while to < end:  # on to the end of the word
            more = data[to : to + SLICE]
            gap = np.flatnonzero(~ink[more])
            if len(gap):
                to = min(to + int(gap[0]), end)
                break
            to = min(to + len(more), end)
        b = low[data[at:to]]
        word = ink[b]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        heads = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        begins[heads] |= word[heads]  # texts lie back to back
        ends = word.copy()
        ends[:-1] &= ~word[1:] | (begins[1:] & word[1:])
        start, size = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size -= start
        if len(start):
            row = np.searchsorted(offsets, start + at, side="right") - 1
            one = _run(np.full(len(start), 0xFFFFFFFF, np.uint32), b, start, size)
            spaced = _step(one, np.uint32(32))
            before_row, before = np.append(row[:1] - 1, row[:-1]), np.append(spaced[:1], spaced[:-1])
            if carried is not None:
                before_row[0], before[0] = carried
            pair = before_row == row
            two = _run(before[pair], b, start[pair], size[pair])
            carried = (row[-1], spaced[-1])
            yield np.append(row, row[pair]), (np.append(one, two) ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)
        at = to


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bucket in features(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(common.text_bytes().alias("text")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share in the target over that in the source."""
    s_all, t_all = int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + BUCKETS) / (float(s + 1) * float(t_all + BUCKETS)))) for s, t in pairs], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, bucket in features(batch.column(1)):
                n += np.bincount(row, minlength=len(n))
                total += np.bincount(row, weights=shared.value[bucket], minlength=len(n))  # whole numbers, exact in doubles
            weight = np.floor_divide(total.astype(np.int64), np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    common.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")).mapInArrow(run, "doc_id long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the hash of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs (doc_id, text): n_features, weight, score, and the rank of those drawn towards target (text)."""
    common.bounded_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = common.written(weighted(docs, gain).withColumn("score", F.col("weight") + noise(seed)))
    # w words make w + w - 1 features
    long_enough = F.col("n_features") >= 2 * least_words - 1
    runs = common.in_order(scored.filter(long_enough), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    at = F.col("base") + F.col("spot") + 1
    drawn = F.floor(F.col("n") * percent / 100)
    placed = runs.join(common.bases(runs), "part").withColumn("rank", F.when(at <= drawn, at))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*names).unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")).select(*names))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

"""Best-fit packing by hierarchical residual packing.

Every group of items is packed best-fit decreasing on its own, and the bins that are nearly full, or that the
smallest item left anywhere can't fill, are emitted. The underfull bins travel on as single items: neighbouring groups
merge, and each round repeats best fit over the leftovers. A bin is one item of the next round, so its contents never
part. Groups hold GROUP items or so in every round, whatever the size of the data: their number follows the count of
the leftovers, down to one group of at most GROUP items, which emits everything. Where a round leaves nearly as many
items as it got (they don't fit each other), it emits them as they are.

Defined results: a null or empty text is the one id 2, hence one piece of length 1; repeated rows of a
doc_id are packed as often as they occur; items of one length are taken by their keys; an empty table gives an empty
result; columns other than doc_id and text are ignored. Any length of text works: pieces leave the tokenizer one
document at a time.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END = 2
#: A bin with no more than this part of its places free is emitted at once.
SLACK = 1 / 128
#: Items of a group, about.
GROUP = 1 << 15
#: A round that leaves more than this part of its items is the last.
STUCK = 0.95

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


@functools.cache
def encoder(path: str | None = None):
    """text -> ids of the tokenizers file byte_bpe_50k.json, through the same ranks in tiktoken where both agree.

    Both libraries hold one vocabulary; the tiktoken form is about four times as fast. The file's special
    token, and letters whose Unicode class the two regex engines may date differently, go to tokenizers.
    """
    import base64

    import public_tokenizers
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    @functools.cache  # few texts need it, so few workers load it
    def slow() -> Tokenizer:
        return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))

    if path is not None:
        return lambda text: slow().encode(text, add_special_tokens=False).ids
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = regex.compile(r"[^\x00-ɏ‐-‧€]|<\|endoftext\|>")

    def encode(text: str) -> list[int]:
        if other.search(text):
            return slow().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full, but for the first, which takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            docs_, out = batch.column("doc_id").to_pylist(), [[] for _ in range(5)]
            for at, doc in enumerate(docs_):
                ids = np.array([*encode(batch.column("text")[at].as_py() or ""), END], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(out, (doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=PIECE_COLUMNS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit over sizes from large to small (ties by position): the positions in each bin.

    Free places are small integers, so bins wait in one list for each number of free places, and the
    tightest that fits is the lowest set bit of a mask.
    """
    bins: list[list[int]] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = waiting[free].pop()
            if not waiting[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        free -= size
        if free:
            waiting[free].append(b)
            mask |= 1 << free
    return bins


def _round(capacity: int, free: int, step: int, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's bins. pdf: used and members (piece keys with lengths), a row for each bin of the round before; a bin with at most `free` places free gets its number."""
    part, pdf = int(key[0]), pdf.sort_values("tie", kind="stable")
    sizes, members, tie = pdf["used"].to_numpy(np.int64), pdf["members"].tolist(), pdf["tie"].tolist()
    rows = []
    for n, bin_ in enumerate(best_fit(sizes, capacity)):
        used = int(sizes[bin_].sum())
        name = (step << 56) + (part << 22) + n
        rows.append((used, [m for i in bin_ for m in members[i]], tie[bin_[0]], name, capacity - used <= free, part))
    return pd.DataFrame(rows, columns=["used", "members", "tie", "sequence_id", "done", "part"])


def _two(run):
    return lambda key, pdf: run(key, pdf)


MEMBER = "array<struct<key:long,length:int>>"


def pack(items: DataFrame, capacity: int = CAPACITY, slack: float = SLACK, group: int = GROUP) -> DataFrame:
    """items (key long, length int; 1 <= length <= capacity) -> key, sequence_id, offset."""
    current = items.select(
        F.col("length").cast("int").alias("used"),
        F.array(F.struct(F.col("key").cast("long").alias("key"), F.col("length").cast("int").alias("length"))).alias("members"),
        F.col("key").cast("long").alias("tie"),
        F.lit(-1).alias("part"),
    )
    done: list[DataFrame] = []
    groups, n, least = None, *current.agg(F.count("*"), F.min("used")).first()
    while n:
        before, groups = groups, -(-n // group)
        # the first round deals items out evenly, later ones merge neighbours
        part = F.pmod(F.xxhash64("tie"), F.lit(groups)) if before is None else F.floor(F.col("part") * groups / before)
        # nothing is smaller than the smallest item, so a bin with less room than that can't be filled any more
        free = capacity if groups == 1 else max(int(capacity * slack), least - 1)
        run = functools.partial(_round, capacity, free, len(done) + 1)
        out_type = f"used int, members {MEMBER}, tie long, sequence_id long, done boolean, part int"
        result = common.written(current.withColumn("part", part.cast("int")).groupBy("part").applyInPandas(_two(run), out_type))
        left, least = result.filter("NOT done").agg(F.count("*"), F.min("used")).first()
        stuck = left > STUCK * n
        done.append(result if stuck else result.filter("done"))
        current, n = result.filter("NOT done").select("used", "members", "tie", "part"), 0 if stuck else left
    if not done:
        return items.select(F.col("key").cast("long").alias("key"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bins = functools.reduce(DataFrame.unionByName, done)
    placed = bins.select(
        "sequence_id",
        F.explode(
            F.aggregate(
                "members",
                F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<key:long,offset:int>>)").alias("out")),
                lambda a, m: F.struct(
                    (a["at"] + m["length"]).alias("at"),
                    F.concat(a["out"], F.array(F.struct(m["key"].alias("key"), a["at"].alias("offset")))).alias("out"),
                ),
            )["out"]
        ).alias("m"),
    )
    return placed.select(F.col("m.key").alias("key"), "sequence_id", F.col("m.offset").cast("long").alias("offset"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece, with its sequence and its place there."""
    rows = common.written(pieces(docs, capacity, tokenizer).withColumn("key", F.monotonically_increasing_id()))
    # A full piece is a bin of its own and takes no part in the rounds.
    full = rows.filter(F.col("length") == capacity)
    rest = rows.filter(F.col("length") < capacity)
    placed = pack(rest.select("key", "length"), capacity)
    alone = full.select(*PIECE_COLUMNS, (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.join(placed, "key").select(*PIECE_COLUMNS, "sequence_id", "offset").unionByName(alone)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(common.table(spark, sf_dir, "documents"))

"""Repeated windows of a corpus: routing by minimisers, shared by the substring operators.

A window is `width` consecutive units (bytes or words) of one document. Its minimiser is the smallest
fingerprint among its grams; equal windows have equal minimisers. Consecutive windows that share the
occurrence of a minimiser form a super-k-mer. Super-k-mers tile the windows of a document.

1. Count super-k-mers for each minimiser. Windows of one super-k-mer differ, so a minimiser met once has no
   repeated window, and most of the corpus ends here without a string having moved.
2. Super-k-mers of one minimiser and one content form a class, whose copies are counted before any shuffle
   by partial aggregation. One string for each class travels to the bucket of its minimiser.
3. A minimiser with over HOT contents sends its windows singly, to buckets by window, so no bucket depends
   on one key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import _powers, mix

#: Positions that one scan takes; longer documents are scanned in pieces that overlap by a window.
SCAN = 1 << 19
HOT = 4096
#: Bytes of strings meant for one bucket.
BUCKET = 1 << 18
PLACE = 20
#: What a string carries to its bucket.
MADE = pa.struct([("mh", pa.int64()), ("ch", pa.int64()), ("copies", pa.int64()), ("off", pa.int32()), ("spot", pa.int32()), ("start", pa.int64()), ("string", pa.binary()), ("key", pa.int64())])


def scan(values: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser (uint64), content (uint64), start, and place of the minimiser << 8 | number of windows, of each super-k-mer of one document."""
    found = []
    if width - gram + 1 > 255:
        raise ValueError("a minimiser's place and its windows must fit in a byte each")
    n_windows = len(values) - width + 1
    for at in range(0, n_windows, SCAN):
        v = values[at : at + SCAN + width - 1]
        n = len(v) - width + 1
        up, down = _powers(1 << max(12, (SCAN + width).bit_length()))
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * up[: len(v)], out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * down[: len(v) - gram + 1])
        low = (grams & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(grams), dtype=np.uint64)
        span, have = width - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        place = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(np.append(start, n))
        end = start + count + width - 1
        content = mix((total[end] - total[start]) * down[start] + mix(end.astype(np.uint64) - start.astype(np.uint64)))
        found.append((grams[place[start]], content, start + at, (place[start] - start) << 8 | count))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """A row key (rid, mark) that holds for null and repeated ids; rid keeps the order of ids, null first. Ids are whole numbers: other text in doc_id is an error."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)) - F.shiftrightunsigned(mark, 3))
    return docs.select(*more, rid.alias("rid"), mark.alias("mark"), "text")


def marked(docs: DataFrame, units: Callable[[str | None], tuple[np.ndarray, int, str]], width: int, gram: int) -> DataFrame:
    """rid, mark, uid, n (units), sha (of a document that keeps all) and super-k-mers of each row.

    units: text -> a uint64 for each unit, their number, the digest of the whole.
    """

    def run(text: list) -> list[list]:
        n, sha, mh, ch, at = [], [], [], [], []
        for t in text:
            values, count, digest = units(t)
            m, c, start, k = scan(values, width, gram)
            n.append(count)
            sha.append(digest)
            mh.append(m.view(np.int64))
            ch.append(c.view(np.int64))
            at.append(start << 16 | k)
        return [n, sha, mh, ch, at]

    rows = keyed(docs, "doc_id")
    added = "n long, sha string, mh array<long>, ch array<long>, at array<long>"
    out = common.with_columns_by(rows, ["doc_id", "rid", "mark"], {"text": F.col("text")}, run, added)
    return common.written(out.withColumn("uid", F.monotonically_increasing_id()))


def survivors(marks: DataFrame) -> DataFrame:
    """Super-k-mers (mh, ch, at, rid, uid) whose minimiser is met more than once."""
    occ = marks.select("rid", "uid", F.explode(F.arrays_zip("mh", "ch", "at")).alias("k")).select("k.mh", "k.ch", "k.at", "rid", "uid")
    often = marks.select(F.explode("mh").alias("mh")).groupBy("mh").agg(F.count("*").alias("c")).filter("c > 1").select("mh")
    often = common.written(often)
    common.released(marks.sparkSession)
    out = common.written(occ.join(often, "mh"))
    common.released(marks.sparkSession)
    return out


def places() -> tuple:
    """Start, number of windows, and place of the minimiser, as columns of what `at` packs."""
    at = F.col("at")
    return F.shiftrightunsigned(at, 16), at.bitwiseAND(255), F.shiftrightunsigned(at, 8).bitwiseAND(255)


def classes(found: DataFrame) -> DataFrame:
    """mh, ch, first (rid, start, uid, k) and copies of each content; contents: number of them at the minimiser."""
    start, k, spot = places()
    first = F.struct("rid", start.alias("start"), "uid", k.alias("k"), spot.alias("spot"))
    each = common.written(found.groupBy("mh", "ch").agg(F.min(first).alias("first"), F.count("*").alias("copies")))
    common.released(found.sparkSession)
    # written first, so that a minimiser with very many contents can be split in the join
    contents = common.written(each.groupBy("mh").agg(F.count("*").alias("contents")).filter("contents > 1"))
    return common.written(each.join(contents, "mh", "left").withColumn("contents", F.coalesce("contents", F.lit(1).cast("long"))))


def strings(docs: DataFrame, marks: DataFrame, some: DataFrame, cut: Callable, width: int, unit_bytes: int) -> DataFrame:
    """bucket, mh, ch, off, spot, rid, start, copies, string: a packed string for each class of `some`, or for each window of a hot one.

    cut: (text, starts, ends) -> the strings between those units. unit_bytes: bytes of a unit, about.
    """
    units = some.agg(F.sum(F.col("first.k") + width)).first()[0] or 0
    buckets = max(1, -(-int(units) * unit_bytes // BUCKET))
    need = some.select("mh", "ch", "copies", "first.*", (F.col("contents") > HOT).alias("hot"))
    need = need.groupBy("uid").agg(F.collect_list(F.struct("mh", "ch", "copies", "start", "k", "spot", "hot")).alias("need"))
    need = common.written(need.join(marks.select("uid", "rid", "mark"), "uid").drop("uid"))
    common.released(docs.sparkSession)
    rows = common.narrowed(keyed(docs), need, ["rid", "mark"])
    wide = rows.join(need, ["rid", "mark"])

    def run(text: pa.Array, need: pa.Array) -> list[pa.Array]:
        rows, flat = np.diff(need.offsets.to_numpy()), need.flatten()
        mh, ch, copies, start, k, spot, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(7))
        n = np.where(hot, k, 1)  # the strings of each class
        of = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        begin = start[of] + off
        end = np.where(hot[of], begin + width, begin + k[of] + width - 1)
        edge = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(rows))]
        made: list[bytes] = []
        for t, i, j in zip(text, edge[:-1], edge[1:], strict=True):
            made += cut(t.as_py(), begin[i:j].tolist(), end[i:j].tolist())
        key = mh[of]
        for i in np.flatnonzero(hot[of]).tolist():
            key[i] = hash_bytes(made[i])
        columns = [mh[of], ch[of], copies[of], off.astype(np.int32), (spot[of] - off).astype(np.int32), begin, made, key]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, MADE, strict=True)]
        return [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(arrays, fields=[MADE.field(i) for i in range(MADE.num_fields)]))]

    made = "made array<struct<mh:long,ch:long,copies:long,off:int,spot:int,start:long,string:binary,key:long>>"
    out = common.with_columns_by(wide, ["rid"], {"text": F.col("text"), "need": F.col("need")}, run, made, raw=True)
    out = out.select("rid", F.explode("made").alias("m")).select("rid", "m.*")
    return out.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).drop("key")


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b) - (1 << 63)


def ranges(mask: np.ndarray, width: int) -> list[dict]:
    """Unit ranges that the windows set in mask cover, relative to the first window."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut_ = np.flatnonzero(np.diff(at) > width)
    return [{"s": int(s), "e": int(e) + width} for s, e in zip(at[np.append(0, cut_ + 1)], at[np.append(cut_, len(at) - 1)], strict=True)]


def covered(n: int, spans: list) -> np.ndarray:
    """Mask of the units that the (s, e) spans cover."""
    turn = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(turn, [x["s"] for x in spans], 1)
        np.add.at(turn, [x["e"] for x in spans], -1)
    return np.cumsum(turn[:-1]) > 0


def with_spans(docs: DataFrame, marks: DataFrame, spans: DataFrame, keep: Callable, added: str) -> DataFrame:
    """Rows of docs that have spans (uid, s, e), with what keep(text, spans) returns for the columns `added`."""
    each = spans.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    each = each.join(marks.select("uid", "rid", "mark"), "uid").groupBy("rid", "mark").agg(F.min_by("spans", "uid").alias("spans"))
    each = common.written(each)
    common.released(docs.sparkSession)
    rows = common.narrowed(keyed(docs), each, ["rid", "mark"])

    def run(text: list, spans: list) -> list[list]:
        return [list(x) for x in zip(*(keep(t, s) for t, s in zip(text, spans, strict=True)), strict=True)] or [[] for _ in added.split(",")]

    out = common.with_columns_by(rows.join(each, ["rid", "mark"]), ["rid", "mark"], {"text": F.col("text"), "spans": F.col("spans")}, run, added)
    return out

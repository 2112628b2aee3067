"""Line dedup by pairwise alignment: patience diff against the documents that held a document's runs of lines first.

Lines are compared without the white space around them, and blank lines are passed over. What may be deleted are runs of consecutive lines of at
least BLOCK characters that an earlier document holds as well. The keys of a document are its shortest such runs:
one from each line onward and one from each line backward; any longer shared run is a union of shared keys. A document
is paired with the first holder of each of its keys: one pair for each key at most, whatever the size of a group of
copies or the number of documents that hold a line, and the rarest as well as the most frequent lines lead to a pair.

What travels of a pair is where both documents hold the shared keys, not their lines. On these, a patience diff
takes the keys that the later document holds once, the longest sequence of them that rises on both sides, and then
the others within the gaps. Keys that meet side by side make up the aligned blocks, which are deleted from the later
document. A key that its holder has in another order, or that the later document repeats, isn't aligned: it is a moved
passage, which stays. With moved=True moved passages are deleted as well, and counted apart; nothing is left then
of what any earlier document holds.

Documents with the same lines throughout are one block, however short: the later ones lose all.

Defined results: null text stays null and has no lines; a blank line goes with the line before it (at the top, with the one after it); rows that repeat a
doc_id are no documents of each other; a null doc_id comes before all others; an empty table gives an empty result;
a line of any length is one line; other columns are passed through, but for those named like a result. Ties don't
arise: ids are ordered, and of a holder's places for a key the first counts.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing, superkmers

BLOCK = 30
BLANK = " \t\n\v\f\r"


def key_runs(sizes: np.ndarray, least: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the shortest runs of at least `least` characters from each line, onward and backward."""
    total = np.append(0, np.cumsum(sizes, dtype=np.int64))
    n = len(sizes)
    s = np.arange(n)
    e = np.searchsorted(total, total[s] + least)
    b = s + 1
    a = np.searchsorted(total, total[b] - least, side="right") - 1
    packed = np.unique(np.concatenate([(s << 32 | e)[e <= n], (a << 32 | b)[a >= 0]]))
    return packed >> 32, packed & 0xFFFF_FFFF


def rising(x: list) -> list[int]:
    """Places of a longest strictly rising subsequence of x, by patience sorting."""
    tops, ends, back = [], [], []
    for i, v in enumerate(x):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(x: list) -> list[int]:
    """Matches of a pair in the order of the later document, x their places in the earlier one: those aligned.

    Keys met once go first, by the longest rising sequence; then those within each gap, between its ends on both sides.
    """
    seen: dict = {}
    for v in x:
        seen[v] = seen.get(v, 0) + 1
    once = [i for i, v in enumerate(x) if seen[v] == 1]
    out, last = [], -1
    for stop in [*(once[k] for k in rising([x[i] for i in once])), len(x)]:
        lo, hi = x[last] if last >= 0 else -1, x[stop] if stop < len(x) else float("inf")
        gap = [i for i in range(last + 1, stop) if lo < x[i] < hi]
        out += [gap[k] for k in rising([x[i] for i in gap])] + [stop]
        last = stop
    return out[:-1]


def _lines(docs: DataFrame) -> DataFrame:
    """rid, mark, n (lines that aren't blank), two fingerprints of them, keys and where they are (start << 32 | end)."""

    def run(text: pa.Array) -> list[list]:
        out: list[list] = [[] for _ in range(5)]
        for t in text:
            data = (t.as_py() or "").encode("utf-8", "replace")
            h, sizes = hashing.lines(data)
            h, sizes = h[h != 0], sizes[h != 0]
            s, e = key_runs(sizes)
            row = len(h), *hashing.digest(h), hashing.signed(hashing.runs(h, s, e)), s << 32 | e
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    added = "n long, d1 long, d2 long, keys array<long>, at array<long>"
    return common.written(common.with_columns_by(superkmers.keyed(docs), ["rid", "mark"], {"text": F.col("text")}, run, added, raw=True))


def _aligned(a: pa.Array, am: pa.Array, x: pa.Array, y: pa.Array) -> list[list]:
    """Of each row's matches (holder, place there, own place), the own places that are aligned and those that are moved."""
    size = np.diff(a.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    a, am, x, y = (c.flatten().to_numpy() for c in (a, am, x, y))
    order = np.lexsort((y, am, a, row))
    row, a, am, x, y = row[order], a[order], am[order], x[order], y[order]
    n = len(row)
    same = np.zeros(n, bool)
    same[1:] = (row[1:] == row[:-1]) & (a[1:] == a[:-1]) & (am[1:] == am[:-1])
    group = np.cumsum(~same) - 1
    falls = np.zeros(n, bool)
    falls[1:] = same[1:] & (x[1:] <= x[:-1])
    fine = np.ones(n, bool)
    starts = np.append(np.flatnonzero(~same), n)
    for g in np.unique(group[falls]).tolist():
        lo, hi = starts[g], starts[g + 1]
        fine[lo:hi] = False
        fine[lo + np.array(patience(x[lo:hi].tolist()), np.int64)] = True
    ends = np.cumsum(size)
    # by row, its own places in order: each row's part is then one slice
    out = []
    for keep in (fine, ~fine):
        r, p = row[keep], y[keep]
        cut = np.searchsorted(r, np.arange(len(ends) + 1))
        out.append([np.unique(p[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
    return out


def aligned(docs: DataFrame) -> DataFrame:
    """rid, mark, spans and moved (places of lines to delete, start << 32 | end) of each row that loses lines."""
    lines = _lines(docs)
    full = lines.filter("n > 0").select("rid", "mark", "n", "d1", "d2")
    copies = common.written(full.groupBy("d1", "d2").agg(F.min("rid").alias("a"), F.max("rid").alias("last")).filter("a < last").drop("last"))
    whole = full.join(copies, ["d1", "d2"]).filter("rid <> a").select("rid", "mark", "a", F.lit(0).cast("long").alias("am"), F.col("n").alias("x"), F.col("n").alias("y"))
    posts = lines.select("rid", "mark", F.explode(F.arrays_zip("keys", "at")).alias("k")).select("rid", "mark", F.col("k.keys").alias("key"), F.col("k.at").alias("y"))
    held = posts.groupBy("key").agg(F.min(F.struct("rid", "mark", F.col("y").alias("x"))).alias("first"), F.max("rid").alias("last")).filter("first.rid < last")
    # written first, so that the join is dealt out anew and a key that many documents hold can be split
    held = common.written(held.select("key", F.col("first.rid").alias("a"), F.col("first.mark").alias("am"), F.col("first.x").alias("x")))
    shared = posts.join(held, "key").filter("rid <> a").select("rid", "mark", "a", "am", "x", "y")
    each = shared.unionByName(whole).groupBy("rid", "mark").agg(F.collect_list(F.struct("a", "am", "x", "y")).alias("m"))
    matches = {c: F.col(f"m.{c}") for c in ("a", "am", "x", "y")}
    return common.with_columns_by(each, ["rid", "mark"], matches, _aligned, "spans array<long>, moved array<long>", raw=True)


def covered(ink: np.ndarray, places: list | None) -> np.ndarray:
    """Mask of the lines that go: those with ink between the start and the end that a place packs, and blank ones behind them."""
    turn = np.zeros(int(ink.sum()) + 1, np.int32)
    p = np.array(places or [], np.int64)
    np.add.at(turn, p >> 32, 1)
    np.add.at(turn, p & 0xFFFF_FFFF, -1)
    gone = np.cumsum(turn[:-1]) > 0
    if not len(gone):
        return np.zeros(len(ink), bool)
    return gone[np.maximum(np.cumsum(ink) - 1, 0)]


RESULTS = ("n_lines", "n_removed", "n_moved")


def deduplicate_lines(docs: DataFrame, moved: bool = False) -> DataFrame:
    """docs with the aligned blocks cut out of text, and n_lines, n_removed and n_moved (lines of moved passages only: removed if `moved`, else left) of each row."""
    names = [c for c in docs.columns if c not in RESULTS]
    spans = aligned(docs).withColumnsRenamed({"rid": "__rid", "mark": "__mark", "spans": "__spans", "moved": "__moved"})
    keyed = superkmers.keyed(docs, *(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(names)))
    keyed = keyed.withColumnsRenamed({"rid": "__rid", "mark": "__mark"}).drop("text")
    # the spans are the smaller side of each partition by far: texts stream past them unsorted
    rows = keyed.join(spans.hint("shuffle_hash"), ["__rid", "__mark"], "left").select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(names)), "__spans", "__moved")

    def run(text: list, spans: list, other: list) -> list[list]:
        out, n, cut, apart = [], [], [], []
        for t, s, o in zip(text, spans, other, strict=True):
            if not s and not o:
                out.append(t)
                n.append(t.count("\n") + 1 if t else 0)
                cut.append(0)
                apart.append(0)
                continue
            parts = t.split("\n")
            ink = np.array([bool(p.strip(BLANK)) for p in parts])
            first, both = covered(ink, s), covered(ink, (s or []) + (o or []))
            gone = both if moved else first
            out.append("\n".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g))
            n.append(len(parts))
            cut.append(int(gone.sum()))
            apart.append(int((both & ~first).sum()))
        return [out, n, cut, apart]

    inputs = {"text": F.col("text"), "spans": F.col("__spans"), "other": F.col("__moved")}
    return common.with_columns_by(rows, names, inputs, run, "text string, n_lines long, n_removed long, n_moved long", replace=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays with its own lines; one that loses all of them is a copy and goes.

    Null, empty and blank texts lose nothing and stay; rows that repeat a doc_id stay each.
    """
    names = docs.columns
    out = deduplicate_lines(docs).filter(~((F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names)

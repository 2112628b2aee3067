"""All-pairs and nearest-neighbour joins of vectors, in blocks.

Rows are dealt into groups by hash; each pair of groups is one task, which goes through it block by block, a matrix
product each. A group holds a bounded number of vectors, so memory doesn't depend on the table, and a vector
travels once for each group; pairs that the caller only counts are counted in the task and never leave it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as v
from .blocks import group_count

#: Vectors in a block, about 1 MB at 64 dimensions.
BLOCK = 2048
#: Vectors of a group at most, about 32 MB, where a task gives no more than its counts.
COUNTED = 65_536
#: Bits of a count's number within its chunk: the angle in millionths of a degree, doubled, and one if the areas are the same.
CHUNK = 17


def unit_rows(df: DataFrame, id_: str, vec: str, *keep: str) -> DataFrame:
    """id, u (unit vector, doubles) and kept columns of the rows with a non-zero vector."""
    return df.select(F.col(id_).alias("id"), v.unit(F.col(vec)).alias("u"), *keep).filter("u IS NOT NULL")


def _blocks(rows: DataFrame, n: int, tag: str) -> DataFrame:
    return rows.withColumn(tag, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def block_count(rows: DataFrame) -> int:
    return group_count(rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def block_pairs(rows: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, columns: list[str], blocks: int | None = None) -> DataFrame:
    """fn(left, right, cosines) for each pair of blocks; a pair of ids appears once, within a group as left id < right id (others are NaN)."""

    def run(pairs: Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]) -> pd.DataFrame:
        out = [fn(a, b, s) for a, b, s in pairs]
        return out[0] if len(out) == 1 else pd.concat(out)

    return _meetings(rows, run, schema, columns, blocks or block_count(rows))


def _meetings(rows: DataFrame, fn: Callable[[Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]], pd.DataFrame], schema: str, columns: list[str], n: int) -> DataFrame:
    """fn of the pairs of blocks (left, right, cosines) of each pair of n groups."""
    x = _blocks(rows.select("id", "u", *columns), n, "b")
    left = x.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("p", F.least("b", "w")).withColumn("q", F.greatest("b", "w"))

    def pairs(key: tuple, pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
        p, q = key
        a, b = pdf[pdf["b"] == p], pdf[pdf["b"] == q]
        if not len(a) or not len(b):
            yield a.iloc[:0], b.iloc[:0], np.empty((0, 0))
            return
        if p == q:  # in the order of ids the blocks below the diagonal hold nothing
            a = b = a.sort_values("id")
        u, w = np.stack(a["u"].to_numpy()), np.stack(b["u"].to_numpy())
        for i in range(0, len(a), BLOCK):
            for j in range(i if p == q else 0, len(b), BLOCK):
                left, right = a.iloc[i : i + BLOCK], b.iloc[j : j + BLOCK]
                s = np.clip(u[i : i + BLOCK] @ w[j : j + BLOCK].T, -1, 1)
                if p == q:
                    s[left["id"].to_numpy()[:, None] >= right["id"].to_numpy()[None, :]] = np.nan
                yield left, right, s

    return left.groupBy("p", "q").applyInPandas(lambda key, pdf: fn(pairs(key, pdf)), schema)


def largest(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first, ties by column; only rows that tie at the k-th are sorted whole."""
    if s.shape[1] <= k:
        return np.argsort(-s, axis=1, kind="stable")
    top = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
    values = np.take_along_axis(s, top, axis=1)
    top = np.take_along_axis(top, np.argsort(-values, axis=1, kind="stable"), axis=1)
    tied = (s >= values.min(axis=1, keepdims=True)).sum(axis=1) > k
    top[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
    return top


def nearest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, column, value to nine decimals of the k largest values of each row, largest first, ties by column; what isn't finite is left out.

    The k-th largest of the maxima of stripes of columns is a bound that few other values reach, so no row is ordered whole.
    """
    if np.isnan(s).any():
        s = np.where(np.isnan(s), -np.inf, s)
    stripes = s.shape[1] // 64
    if stripes >= k:
        most = s[:, : stripes * 64].reshape(len(s), 64, stripes).max(axis=1)
        bound = np.partition(most, stripes - k, axis=1)[:, stripes - k]
    else:
        bound = np.full(len(s), -np.inf)
    row, col = np.nonzero(s >= bound[:, None] - 2e-9)  # what rounds to the bound, too
    value = s[row, col]
    ok = np.isfinite(value)
    row, col, value = row[ok], col[ok], np.round(value[ok], 9)
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, row)
    some = np.arange(len(row)) - first < k
    return row[some], col[some], value[some]


def knn(rows: DataFrame, queries: DataFrame, k: int, columns: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """query, id, sim, rank and kept columns of the k nearest rows of each query, itself excluded, ties by id.

    Each task takes one group of rows and all queries of one group, 128 at a time, and keeps k rows for each query, so
    what is shuffled next is k rows for each query and group; groups are as large as COUNTED, so these are few.
    """
    columns = columns or []
    n = blocks or group_count(rows.count(), rows.sparkSession.sparkContext.defaultParallelism, COUNTED)
    x = _blocks(rows.select("id", "u", *columns), n, "p").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # names of its own: the queries may be the rows themselves
    y = _blocks(queries.select("id", "u"), n, "q").select(F.col("id").alias("qid"), F.col("u").alias("qu"), "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kept = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in columns}
    schema = ", ".join(["query long", "id long", "sim double", *(f"{c} {t}" for c, t in kept.items())])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a = a.sort_values("id")
            ids, u = a["id"].to_numpy(), np.stack(a["u"].to_numpy()).T
            qids, v = b["qid"].to_numpy(), np.stack(b["qu"].to_numpy())
            for at in range(0, len(b), 128):
                q = qids[at : at + 128]
                s = v[at : at + 128] @ u
                s[q[:, None] == ids[None, :]] = -np.inf
                row, col, sims = nearest(s, k)
                out.append(pd.DataFrame({"query": q[row], "id": ids[col], "sim": sims, **{c: a[c].to_numpy()[col] for c in columns}}))
        cols = ["query", "id", "sim", *columns]
        return pd.concat(out)[cols] if out else pd.DataFrame({c: [] for c in cols})

    found = x.groupBy("p", "q").cogroup(y.groupBy("p", "q")).applyInPandas(run, schema)
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def angle_histogram(rows: DataFrame, area: str, width: float, blocks: int | None = None) -> DataFrame:
    """bin, pairs, same: of all pairs, how many fall in each bin of the angle, and how many of those are of one area."""

    def fn(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        ok = ~np.isnan(s)
        angle = np.round(np.degrees(np.arccos(s[ok])), 6)
        same = (a[area].to_numpy()[:, None] == b[area].to_numpy()[None, :])[ok] if s.size else np.empty(0, bool)
        bins = np.floor(angle / width).astype(np.int64)
        n, y = np.bincount(bins), np.bincount(bins, weights=same)
        some = np.flatnonzero(n)
        return pd.DataFrame({"bin": some, "pairs": n[some], "same": y[some].astype(np.int64)})

    parts = block_pairs(rows, fn, "bin long, pairs long, same long", [area], blocks)
    return parts.groupBy("bin").agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same"))


def angle_chunks(rows: DataFrame, area: str, blocks: int | None = None) -> DataFrame:
    """chunk, pw, nw, won: counts of all pairs by angle to six decimals, taken together in chunks of neighbouring angles.

    pw: pairs of one area; nw: others; won: of the chunk's pw times nw, those where the other's angle is larger, ties half.
    A task counts in arrays that don't grow with its pairs, since six decimals leave so many angles; few tasks, three or
    so for each core, so what travels doesn't grow with the pairs either.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = blocks or group_count(rows.count(), math.ceil(1.5 * cores), COUNTED)

    def run(pairs: Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]) -> pd.DataFrame:
        counts: dict[int, np.ndarray] = {}
        out = []
        for a, b, s in pairs:
            ok = ~np.isnan(s)
            code = np.rint(np.degrees(np.arccos(s[ok])) * 1e6).astype(np.int32) * 2
            code += (a[area].to_numpy()[:, None] == b[area].to_numpy()[None, :])[ok]
            code.sort()
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
            times, code = np.diff(np.append(first, len(code))), code[first]
            ends = np.flatnonzero(np.diff(code >> CHUNK, append=-1)) + 1
            for at, to in zip(np.concatenate(([0], ends[:-1])), ends, strict=True) if len(code) else ():
                chunk = int(code[at] >> CHUNK)
                held = counts.get(chunk)
                if held is None:
                    held = counts[chunk] = np.zeros(1 << CHUNK, np.uint16)
                place = code[at:to] & ((1 << CHUNK) - 1)
                total = held[place] + times[at:to]
                over = total >> 16
                if over.any():  # what two bytes don't hold goes as a chunk of its own
                    high = np.zeros(1 << CHUNK, np.uint32)
                    high[place] = over << 16
                    out.append((chunk, 4, zlib.compress(high.tobytes(), 1)))
                held[place] = total & 0xFFFF
        out += [(chunk, 2, zlib.compress(held.tobytes(), 1)) for chunk, held in counts.items()]
        return pd.DataFrame(out, columns=["chunk", "width", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << CHUNK, np.int64)
        for width, packed in zip(pdf["width"], pdf["counts"], strict=True):
            total += np.frombuffer(zlib.decompress(packed), np.uint16 if width == 2 else np.uint32)
        nw, pw = total[0::2].astype(np.float64), total[1::2].astype(np.float64)
        larger = nw.sum() - np.cumsum(nw)
        return pd.DataFrame({"chunk": [key[0]], "pw": [pw.sum()], "nw": [nw.sum()], "won": [(pw * (larger + 0.5 * nw)).sum()]})

    parts = _meetings(rows, run, "chunk int, width int, counts binary", [area], n)
    return parts.groupBy("chunk").applyInPandas(add, "chunk int, pw double, nw double, won double")


def angle_auc(rows: DataFrame, area: str, blocks: int | None = None) -> DataFrame:
    """auc, positives, negatives: chance that a pair of one area has a smaller angle, to six decimals, than another; ties count half."""
    x = angle_chunks(rows, area, blocks)
    larger = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)  # 2,747 rows at most
    x = x.withColumn("larger", F.coalesce(F.sum("nw").over(larger), F.lit(0.0)))
    pairs = F.sum("pw") * F.sum("nw")
    return x.agg(F.when(pairs > 0, F.sum(F.col("won") + F.col("pw") * F.col("larger")) / pairs).alias("auc"), F.sum("pw").alias("positives"), F.sum("nw").alias("negatives"))


def histogram_auc(hist: DataFrame, bins: str = "bin", all_: str = "pairs", pos: str = "same") -> DataFrame:
    """AUC of a binned population (positives included) where smaller bins rank higher, ties within a bin counting half."""
    from .rank import cumulative

    x = cumulative(hist.withColumn("neg", F.col(all_) - F.col(pos)), bins, ["neg"])
    total = x.agg(F.sum("neg").alias("__n"))
    x = x.crossJoin(F.broadcast(total))
    won = F.sum(F.col(pos) * (F.col("__n") - F.col("neg_below") - 0.5 * F.col("neg")))
    pairs = F.sum(pos) * F.sum("neg")
    return x.agg(F.when(pairs > 0, won / pairs).alias("auc"))


def centroids(rows: DataFrame, by: str, vec: str = "u") -> DataFrame:
    """by, c, size: unit mean of the vectors of each group, dimension by dimension in the JVM."""
    x = rows.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    x = x.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"), F.max("n").alias("size"))
    return x.select(by, v.unit(F.transform("c", lambda s: s["m"])).alias("c"), "size")


def mixing(neighbours: DataFrame, area: str, k: int) -> DataFrame:
    """query, mixing, sparsity: 1 - share of the most common area among k neighbours; 1 - mean similarity."""
    n = neighbours.groupBy("query", area).agg(F.count("*").alias("n"), F.sum("sim").alias("s"))
    return n.groupBy("query").agg((1 - F.max("n") / F.lit(k)).alias("mixing"), (1 - F.sum("s") / F.lit(k)).alias("sparsity"))

"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed by TABLES tables of HASHES Gaussian (2-stable) projections cut into cells of width
WIDTH. A query visits, in each table, its own bucket and the PROBES - 1 buckets most likely to hold near
vectors: perturbations of its cell by one step in some projections, in the order of the estimated success,
the sum of the squared distances to the walls stepped over (Lv et al., 2007). Each bucket returns its K
nearest for each query that visits it; candidates of all tables are merged and reranked by exact cosines.

Equal vectors are one with its smallest ids, so a vector that many rows hold costs as one. Buckets over
SPLIT vectors are salted by vector, and their queries go to every part; no bucket is capped. The
projections are drawn from a seed, so nothing is fitted on data.

Defined results: vectors that are null, zero, or hold null or non-finite components, take no part, neither
as queries nor as candidates; rows that repeat a vec_id and its vector count once; candidates of another
length than the query's take no part for it; rows with a null vec_id take no part; a vec_id with several vectors counts with its nearest one; a query
whose buckets hold fewer than K others is searched exactly, so only fewer candidates than K give fewer rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectors

TABLES = 16
HASHES = 8
WIDTH = 2.5
PROBES = 10
K = 5
EVERY = 50
SPLIT = 4096
#: Index rows meant for one group of buckets, as one task takes them at a time.
GROUP = 8192
SEED = 11
#: Queries of one exact pass over all vectors.
EXACT = 256


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim))
    return rng.normal(size=(dim, TABLES * HASHES)) / WIDTH, rng.uniform(size=TABLES * HASHES)


def spots(x: np.ndarray) -> np.ndarray:
    """Place on each projection, in cells: (rows, TABLES, HASHES)."""
    a, b = projections(x.shape[1])
    return (vectors.unit(x) @ a + b).reshape(len(x), TABLES, HASHES)


def perturbations(frac: np.ndarray, probes: int) -> list[np.ndarray]:
    """Steps (-1, 0, 1) in each projection for the `probes` likeliest buckets, the query's own first; frac: place within the cell."""
    m = len(frac)
    score = np.concatenate([frac**2, (1 - frac) ** 2])
    order = np.argsort(score, kind="stable")
    score = score[order]
    moves = [(int(k % m), -1 if k < m else 1) for k in order]
    out = [np.zeros(m, np.int64)]
    heap = [(score[0], (0,))]
    while heap and len(out) < probes:
        s, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*chosen, last + 1)))
        axes = [moves[c][0] for c in chosen]
        if len(set(axes)) == len(axes):
            step = np.zeros(m, np.int64)
            for c in chosen:
                step[moves[c][0]] = moves[c][1]
            out.append(step)
    return out


def _codes(cells: np.ndarray, table: int, dim: int) -> np.ndarray:
    """One signed number for each bucket: a row of cells in a table."""
    h = np.full(len(cells), (table * 1_000_003 + dim) & 0xFFFF_FFFF, np.uint64)
    for k in range(cells.shape[1]):
        h = (h ^ cells[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _by_dim(v: list) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, x in enumerate(v):
        out.setdefault(len(x), []).append(i)
    return out


def _index(v: list) -> list[list]:
    out: list = [None] * len(v)
    for dim, at in _by_dim(v).items():
        cells = np.floor(spots(np.array([v[i] for i in at], np.float64)))
        codes = np.stack([_codes(cells[:, t], t, dim) for t in range(TABLES)], axis=1)
        for i, row in zip(at, codes.tolist(), strict=True):
            out[i] = row
    return [out]


def _visits(v: list) -> list[list]:
    out: list = [None] * len(v)
    for dim, at in _by_dim(v).items():
        where = spots(np.array([v[i] for i in at], np.float64))
        cells = np.floor(where)
        for n, i in enumerate(at):
            row = []
            for t in range(TABLES):
                steps = np.array(perturbations(where[n, t] - cells[n, t], PROBES))
                row += _codes(cells[n, t].astype(np.int64) + steps, t, dim).tolist()
            out[i] = row
    return [out]


def _nearest(score: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Columns of the k largest scores, ties by id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge - 1e-9)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k].tolist()


def _group(k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A group holds many buckets: of each query in a bucket, the k nearest vectors there (one more, as its own may be among them)."""
    queries, reps = [], []
    left, right = left.sort_values("slot", kind="stable"), right.sort_values("slot", kind="stable")
    here, there = left["slot"].to_numpy(), right["slot"].to_numpy()
    names, ids, ql, vr = left["query_id"].tolist(), right["rep"].to_numpy(), left["v"].to_numpy(), right["v"].to_numpy()
    for slot, at in zip(*np.unique(here, return_index=True), strict=True):
        to = np.searchsorted(here, slot, side="right")
        lo, hi = np.searchsorted(there, slot), np.searchsorted(there, slot, side="right")
        if lo == hi:
            continue
        u = vectors.unit(np.stack(vr[lo:hi]).astype(np.float64)).T
        for a in range(at, to, 256):
            b = min(to, a + 256)
            for q, s in zip(names[a:b], vectors.unit(np.stack(ql[a:b]).astype(np.float64)) @ u, strict=True):
                some = _nearest(s, ids[lo:hi], k + 1)
                queries += [q] * len(some)
                reps += ids[lo:hi][some].tolist()
    return pd.DataFrame({"query_id": np.array(queries, np.int64), "rep": np.array(reps, np.int64)})


def search(table: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """table (vec_id, embedding) -> query_id, rank, vec_id, score."""
    spark = table.sparkSession
    rows = vectors.plain(table).distinct()
    # single precision is shipped as such
    slim = dict(table.dtypes)["embedding"] if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    # the smallest k + 1 ids of each vector are all that a query can see of it; gathered in two steps, as one vector may have any number of rows
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(8 * common.parallelism(spark)))
    some = rows.groupBy("v", salt.alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    kinds = common.written(some.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).withColumn("rep", F.col("ids")[0]))
    queries = common.written(rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"))
    index = common.with_columns_by(kinds.select("rep", "v"), ["rep"], {"v": F.col("v")}, _index, "codes array<long>")
    index = common.written(index.select("rep", F.explode("codes").alias("code")))
    parts = index.groupBy("code").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    index = index.join(parts, "code").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).join(kinds.select("rep", F.col("v").cast(slim).alias("v")), "rep")
    visits = common.with_columns_by(queries, ["query_id"], {"v": F.col("v")}, _visits, "codes array<long>")
    visits = visits.select("query_id", F.explode(F.array_distinct("codes")).alias("code")).join(parts, "code")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(queries.select("query_id", F.col("v").cast(slim).alias("v")), "query_id")
    found = _gathered(visits, index, k)
    pairs = common.written(found.distinct())
    wide = pairs.join(queries.withColumnRenamed("v", "q"), "query_id").join(kinds, "rep")
    scored = common.with_columns_by(wide.filter(F.size("q") == F.size("v")), ["query_id", "ids"], {"q": F.col("q"), "v": F.col("v")}, _scores, "score double")
    top = common.written(_ranked(scored, k))
    full = top.groupBy("query_id").count().filter(F.col("count") >= k)
    short = common.written(queries.join(full, "query_id", "left_anti").select("query_id", F.col("v").alias("q")))
    parts = -(-short.count() // EXACT)
    if not parts:
        return top
    rest = [_exact(short.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p), kinds, k) for p in range(parts)]
    again = _ranked(functools.reduce(DataFrame.unionByName, rest), k)
    return top.join(short.select("query_id"), "query_id", "left_anti").select(*again.columns).unionByName(again)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """scored: query_id, ids of one vector, score -> each query's k nearest."""
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(some: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """query_id, ids, score of the nearest vectors of each partition, for about EXACT queries against all vectors."""
    names, vs = zip(*((r["query_id"], r["q"]) for r in some.collect()), strict=True) if not some.isEmpty() else ((), ())
    shared = kinds.sparkSession.sparkContext.broadcast((names, vs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vs = shared.value
        for b in batches:
            v, ids = b.column("v").to_pylist(), b.column("ids").to_pylist()
            out = []
            for name, q in zip(names, vs, strict=True):
                at = [i for i, x in enumerate(v) if len(x) == len(q)]
                if at:
                    score = vectors.cosine(np.array(q)[None], np.array([v[i] for i in at]))
                    others: set = set()  # ids other than the query's, of which some may have several vectors
                    for i in np.lexsort(([ids[i][0] for i in at], -score)).tolist():
                        out.append((name, ids[at[i]], float(score[i])))
                        others.update(ids[at[i]])
                        if len(others - {name}) >= k:
                            break
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.float64()), strict=True)], names=["query_id", "ids", "score"])

    return kinds.select("ids", "v").mapInArrow(run, "query_id long, ids array<long>, score double")


def _scores(q: list, v: list) -> list[list]:
    return [[float(vectors.cosine(np.array(a), np.array(b))) for a, b in zip(q, v, strict=True)]]


def _gathered(visits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    groups = max(1, -(-index.count() // GROUP))
    slot = F.xxhash64("code", "part")
    left = visits.select(slot.alias("slot"), "query_id", "v").withColumn("g", F.pmod("slot", F.lit(groups)))
    right = index.select(slot.alias("slot"), "rep", "v").withColumn("g", F.pmod("slot", F.lit(groups)))
    run = lambda a, b: _group(k, a, b)
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInPandas(run, "query_id long, rep long")


def op10_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))

"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2 t). Vectors are turned to their principal axes and
sorted by grid cells of width eps on the leading ones (the epsilon grid order). The sorted sequence is cut
into blocks with bounding boxes, and blocks into strips. The whole sequence is joined with itself recursively: a
pair of intervals whose boxes are further apart than eps is provably distant and ends there, any other goes on as
the pairs of its FAN parts. Down to strips these steps are joins on the parents' numbers; a pair of strips that is
left goes to one task, each block once, where the recursion goes on over blocks and runs of vectors.

Equal vectors are one with a multiplicity, so a vector that a third of all rows hold costs as one. A pair of
blocks gives the number of links of each of its vectors and at most a spanning forest of them, never all
its links.

Defined results: vectors that are null, zero, or hold null or non-finite components, have no links and are
their own component, as have vectors of another length than the rest with any but those of their length;
rows that repeat a vec_id and its vector count once; a null vec_id is returned with null component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectors
from .components import components

THRESHOLD = 0.95
#: Axes of the grid, and of the bounding boxes.
AXES = 8
BOX = 32
#: Vectors in a block at most, and bytes of their doubles; so a pair of strips has the same size in any dimension.
BLOCK, BYTES = 4096, 2 << 20
LEAF = 512
#: How far from the threshold a product's rounding can't decide.
NARROW = 1e-9
#: Parts of an interval of strips; blocks in a strip at most.
FAN = 8
STRIP = 16


def _axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Principal axes as columns, from all vectors: sums of products, added up in the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            u = vectors.unit(vectors.matrix(b.column("v")))
            u = np.concatenate([u, np.ones((len(u), 1))], axis=1)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "s"])

    sums = rows.select("v").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow().sort_by("k")
    total = sums.column("s").to_numpy().reshape(dim + 1, dim + 1)
    n, s = total[dim, dim], total[dim, :dim]
    _, axes = np.linalg.eigh(total[:dim, :dim] / n - np.outer(s / n, s / n))
    return axes[:, ::-1]


def _apart(a: tuple, b: tuple) -> float:
    """Distance between two boxes (low, high)."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(np.sqrt((gap * gap).sum()))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of n nodes under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def join(x: np.ndarray, u: np.ndarray, p: np.ndarray, y: np.ndarray, w: np.ndarray, q: np.ndarray, t: float, eps: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """Links of two blocks, a LEAF by LEAF part at a time: where the part begins in each, and which of its pairs are linked.

    x, u, p: a block's vectors, their directions, and these on the leading principal axes; y, w, q: the other's. same: a
    block with itself, of which each pair comes once. The product decides, but for pairs so near the threshold that its
    rounding could; these are computed by the plain formula.
    """
    todo = [(0, len(u), 0, len(w))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        left, right = p[a0:a1], q[b0:b1]
        if _apart((left.min(0), left.max(0)), (right.min(0), right.max(0))) > eps:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            s = u[a0:a1] @ w[b0:b1].T
            linked = s >= t
            i, j = np.nonzero(np.abs(s - t) <= NARROW)
            linked[i, j] = vectors.cosine(x[a0 + i], y[b0 + j]) >= t
            if same:
                linked &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
            if linked.any():
                yield a0, b0, linked
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            todo += [(a0, a1, b0, m), (a0, a1, m, b1)]


def block_rows(dim: int) -> int:
    """Vectors in a block of so many dimensions."""
    return max(1, min(BLOCK, BYTES // (8 * dim)))


def _blocks(kinds: DataFrame, axes: np.ndarray, eps: float, dim: int) -> DataFrame:
    """The sorted sequence in blocks: low and high on the leading axes, ids, counts and vectors packed."""
    shared = kinds.sparkSession.sparkContext.broadcast(axes)
    grid = min(AXES, dim)

    def place(v: list) -> list[list]:
        if not v:
            return [[]]
        y = vectors.unit(np.array(v, np.float64)) @ shared.value[:, :grid]
        return [np.floor(y / eps).astype(np.int32).tolist()]

    placed = common.with_columns_by(kinds, ["rep", "copies", "v"], {"v": F.col("v")}, place, "cell array<int>")
    cells = [F.col("cell")[k] for k in range(grid)]
    placed = placed.repartitionByRange(common.parallelism(kinds.sparkSession), *cells, "rep").sortWithinPartitions(*cells, "rep")
    box, most = min(BOX, dim), block_rows(dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts):
            ids = np.concatenate([p.column("rep").to_numpy() for p in parts])
            copies = np.concatenate([p.column("copies").to_numpy() for p in parts])
            x = np.concatenate([vectors.matrix(p.column("v")) for p in parts])
            y = vectors.unit(x) @ shared.value[:, :box]
            slim = x.astype(np.float32)  # half the bytes, where nothing is lost
            values = [[y.min(0).tolist()], [y.max(0).tolist()], [ids.tobytes()], [copies.tobytes()], [(slim if (slim == x).all() else x).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in values], names=["lo", "hi", "ids", "copies", "x"])

        waiting, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - n)
                waiting.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == most:
                    yield block(waiting)
                    waiting, n = [], 0
        if waiting:
            yield block(waiting)

    out = placed.select("rep", "copies", "v").mapInArrow(pack, "lo array<double>, hi array<double>, ids binary, copies binary, x binary")
    out = common.written(out.withColumn("block", F.monotonically_increasing_id()))
    # consecutive numbers: the count of the partitions before (as many as the session deals out), and the place within one
    part = F.shiftrightunsigned("block", 33)
    parts = out.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    return out.withColumn("part", part).join(parts, "part").withColumn("block", F.col("before") + F.col("block").bitwiseAND((1 << 33) - 1)).drop("part", "before")


def _tiles(boxes: DataFrame, n: int, eps: float, box: int) -> DataFrame:
    """Pairs (a, b), a <= b, of strips that may hold links. boxes: strip, lo, hi; n: number of strips."""
    def level(width: int) -> DataFrame:
        low = F.array(*(F.min(F.col("lo")[k]) for k in range(box)))
        high = F.array(*(F.max(F.col("hi")[k]) for k in range(box)))
        return boxes.groupBy(F.floor(F.col("strip") / width).alias("id")).agg(low.alias("lo"), high.alias("hi")).withColumn("up", F.floor(F.col("id") / FAN))

    gap = F.aggregate(
        F.arrays_zip("alo", "ahi", "blo", "bhi"),
        F.lit(0.0),
        lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["alo"] - x["bhi"], x["blo"] - x["ahi"]), F.lit(2.0)),
    )
    width = 1
    while width < n:
        width *= FAN
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    while width > 1:
        width //= FAN
        parts = level(width)
        left = parts.select(F.col("up").alias("pa"), F.col("id").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        right = parts.select(F.col("up").alias("pb"), F.col("id").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        pairs = pairs.toDF("pa", "pb").join(left, "pa").join(right, "pb").filter("a <= b").filter(gap <= eps * eps + 1e-9).select("a", "b")
        pairs = common.written(pairs)
    return pairs


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """table (vec_id, embedding) -> vec_id, n_links, component_id, kept of each row."""
    eps = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    rows = vectors.plain(table).distinct()
    kinds = common.written(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sizes = [r["d"] for r in kinds.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    links, edges = [], []
    for dim in sizes:
        some = kinds.filter(F.size("v") == dim)
        axes = _axes(some, dim)
        found = common.written(_joined(_blocks(some, axes, eps, dim), axes, threshold, eps, dim))
        links.append(found.filter("kind = 0").select(F.col("a").alias("rep"), F.col("b").alias("n")))
        edges.append(found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = rows.join(kinds, "v").select("vec_id", "rep", "copies")
    members = common.written(members)
    for more in links[1:]:
        links[0] = links[0].union(more)
    for more in edges[1:]:
        edges[0] = edges[0].union(more)
    copies = members.filter("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    parts = components(edges[0].union(copies) if edges else copies)
    if links:
        n = links[0].groupBy("rep").agg(F.sum("n").alias("n"))
        members = members.join(n, "rep", "left")
    else:
        members = members.withColumn("n", F.lit(0))
    # a vec_id with several vectors has the links of all of them
    counts = members.groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = table.select(F.col("vec_id").cast("long").alias("vec_id")).join(counts, "vec_id", "left").join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _strip(blocks: int, tasks: int) -> int:
    """Blocks in a strip: so many that pairs of strips are several times the tasks, and each block travels seldom."""
    return max(1, min(STRIP, int(blocks / np.sqrt(4 * tasks))))


def _joined(blocks: DataFrame, axes: np.ndarray, threshold: float, eps: float, dim: int) -> DataFrame:
    """kind 0: a vector and the number of vectors linked to it in a pair of strips; kind 1: a link of their forest."""
    spark, box = blocks.sparkSession, min(BOX, dim)
    n = blocks.count()
    strip = _strip(n, common.parallelism(spark))
    placed = blocks.withColumn("strip", F.floor(F.col("block") / strip))
    tiles = _tiles(placed.select("strip", "lo", "hi"), -(-n // strip), eps, box)
    members = tiles.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("strip"))
    shared = spark.sparkContext.broadcast(axes[:, :box])

    def run(tile: pa.Table) -> pa.Table:
        same = tile.column("a")[0] == tile.column("b")[0]
        parts = []
        for r in tile.sort_by("block").to_pylist():
            ids, copies = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64)
            x = np.frombuffer(r["x"], np.float32 if len(r["x"]) == 4 * dim * len(ids) else np.float64).reshape(-1, dim).astype(np.float64)
            u = vectors.unit(x)
            parts.append((r["strip"] == r["a"], ids, copies, x, u, u @ shared.value, (np.array(r["lo"]), np.array(r["hi"]))))
        first = np.cumsum([0, *(len(p[1]) for p in parts)])
        ids = np.concatenate([p[1] for p in parts])
        count, tied = np.zeros(len(ids), np.int64), []
        for m, (left, _, na, xa, ua, pa_, ba) in enumerate(parts):
            for k, (_, _, nb, xb, ub, pb, bb) in enumerate(parts[m:] if same else parts, m if same else 0):
                if not same and (not left or parts[k][0]) or _apart(ba, bb) > eps + 1e-9:
                    continue
                for a0, b0, linked in join(xa, ua, pa_, xb, ub, pb, threshold, eps + 1e-9, m == k):
                    here, there = first[m] + a0 + np.arange(linked.shape[0]), first[k] + b0 + np.arange(linked.shape[1])
                    count[here] += linked @ nb[b0 : b0 + len(there)]
                    count[there] += na[a0 : a0 + len(here)] @ linked
                    # of the part's links a forest is kept
                    i, j = np.nonzero(linked)
                    label = forest(i, len(here) + j, len(here) + len(there))
                    node = np.concatenate([here, there])
                    met = np.flatnonzero(label != np.arange(len(node)))
                    tied.append((node[met], node[label[met]]))
        some = np.flatnonzero(count)
        if tied:
            label = forest(np.concatenate([a for a, _ in tied]), np.concatenate([b for _, b in tied]), len(ids))
        else:
            label = np.arange(len(ids))
        ties = np.flatnonzero(label != np.arange(len(ids)))
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(ties)])
        return pa.table({"kind": kind, "a": np.concatenate([ids[some], ids[ties]]), "b": np.concatenate([count[some], ids[label[ties]]])})

    return members.join(placed, "strip").groupBy("a", "b").applyInArrow(run, "kind int, a long, b long")


def op8_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))

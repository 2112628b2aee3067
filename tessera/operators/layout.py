"""Projection of vectors onto a sphere, what it keeps of each, and a layout that pulls neighbours together on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import settled
from . import resample
from .dictionary import numbered


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of the vectors (u): a sum of products for each task, added up over a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                z = np.column_stack([np.ones(len(x)), x])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.select("u").mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]))
    total = parts.treeAggregate(None, _added, _added)
    if total is None:
        return 0, np.empty(0), np.empty((0, 0))
    width = round(len(total) ** 0.5)
    s = total.reshape(width, width)
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    return int(n), mean, s[1:, 1:] / n - np.outer(mean, mean)


def _added(a, b):
    return b if a is None else a if b is None else a + b


def _along(w: np.ndarray, mean: np.ndarray) -> Column:
    shift = float(w @ mean)
    return F.aggregate(F.zip_with("u", F.lit(w.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - shift


def sphere(rows: DataFrame, id_: str = "id") -> DataFrame:
    """id, x, y, z, fidelity of the vectors (u): direction along the three axes of most variance, and the part of the squared length that these keep.

    Of an axis' two directions, the one in which its largest coefficient is positive. A vector at the mean has no
    direction: nulls.
    """
    n, mean, cov = moments(rows)
    if not n:
        return rows.select(id_, *(F.lit(0.0).alias(c) for c in ("x", "y", "z", "fidelity")))
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :3].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    axes = np.vstack([axes, np.zeros((3 - len(axes), len(mean)))])
    p = rows.select(id_, *(_along(w, mean).alias(c) for w, c in zip(axes, ("x", "y", "z"), strict=True)), F.aggregate(F.zip_with("u", F.lit(mean.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e).alias("__all"))
    kept = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    p = p.withColumn("__kept", kept)
    length = F.when(F.col("__kept") > 0, F.sqrt("__kept"))
    return p.select(id_, *((F.col(c) / length).alias(c) for c in ("x", "y", "z")), F.when(F.col("__all") > 0, F.col("__kept") / F.col("__all")).alias("fidelity"))


def layout(points: DataFrame, neighbours: DataFrame, k: int, epochs: int = 300, rate: float = 0.08, repel: float = 0.15, still: float = 1e-4, seed: str = "layout") -> DataFrame:
    """id, x, y, z: points (id, x, y, z) on the sphere after rounds of pulling them to their neighbours (query, id) and pushing them from others.

    An edge pulls both its ends. For each edge and round a hash draws one other point that pushes. A round is three
    joins by number and one sum for each point; its positions are written, so a lost executor costs a round. The rounds
    end early when no coordinate moves by more than `still`.
    """
    named = settled(numbered(points.select("id"), ["id"], "n"))
    count = named.count()
    edges = neighbours.select("query", "id").join(named.toDF("query", "a"), "query").join(named.toDF("id", "b"), "id").select("a", "b")
    edges = edges.union(edges.select("b", "a"))
    place = settled(points.join(named, "id").select("n", "x", "y", "z"))
    edges = settled(edges.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("bs")).select(F.col("a"), F.posexplode("bs").alias("slot", "b")))
    at = lambda df, key, tag: df.toDF(key, *(f"{c}{tag}" for c in "xyz"))
    for e in range(epochs):
        lr = rate * (1 - e / epochs) + 0.005
        other = F.floor(resample.uniform(f"{seed}{e}", "a", "slot") * count).cast("long")
        x = edges.withColumn("o", other).join(at(place, "a", "_a"), "a").join(at(place, "b", "_b"), "b").join(at(place, "o", "_o"), "o")
        gap = [F.col(f"{c}_o") - F.col(f"{c}_a") for c in "xyz"]
        far = F.lit(0.05) + sum((g * g for g in gap[1:]), gap[0] * gap[0])
        step = [F.sum(F.col(f"{c}_b") - F.col(f"{c}_a") - repel * g / far).alias(f"d{c}") for c, g in zip("xyz", gap, strict=True)]
        moved = place.join(x.groupBy(F.col("a").alias("n")).agg(*step), "n", "left")
        new = moved.select("n", *((F.col(c) + lr / k * F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "xyz"), *(F.col(c).alias(f"{c}_was") for c in "xyz"))
        size = F.sqrt(sum((F.col(c) * F.col(c) for c in "yz"), F.col("x") * F.col("x")))
        new = settled(new.select("n", *((F.col(c) / F.when(size > 0, size)).alias(c) for c in "xyz"), *(f"{c}_was" for c in "xyz")))
        most = new.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"{c}_was")) for c in "xyz")))).first()[0]
        place = new.select("n", "x", "y", "z")
        if most is None or most < still:
            break
    return named.join(place, "n").select("id", "x", "y", "z")

"""Forecast models on pyspark.ml: scaled logistic regression, out-of-fold scores, Poisson regression, SVD similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import unit
from ..sources.sinks import settled
from . import resample
from .dictionary import numbered


#: Columns of a matrix whose products of columns go to the driver, 32 MB at most.
GRAM = 2048


def moments(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature: one row to the driver."""
    row = df.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}


def scaled(df: DataFrame, how: dict[str, tuple[float, float]], out: str = "x") -> DataFrame:
    names = [f"__{f}" for f in how]
    cols = df.select("*", *(((F.col(f) - m) / F.lit(s or 1.0)).alias(n) for n, (f, (m, s)) in zip(names, how.items(), strict=True)))
    return VectorAssembler(inputCols=names, outputCol=out).transform(cols).drop(*names)


def logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0) -> tuple[LogisticRegressionModel, dict]:
    """Logistic regression on scaled features with penalty 1 / (c n) and a free intercept."""
    how = moments(df, features)
    n = df.count()
    x = scaled(df, how).withColumn("__y", F.col(label).cast("double"))
    fit = LogisticRegression(featuresCol="x", labelCol="__y", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-8)
    return fit.fit(x), how


def score(df: DataFrame, model: LogisticRegressionModel, how: dict, out: str = "score") -> DataFrame:
    """df with the model's log-odds."""
    odds = F.element_at(vector_to_array(F.col("rawPrediction")), 2)
    drop = ["x", "rawPrediction", "probability", "prediction"]
    return model.transform(scaled(df, how)).withColumn(out, odds).drop(*drop)


def fold(key: str, folds: int = 5, seed: str = "fold") -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds))


def out_of_fold(df: DataFrame, features: list[str], label: str, group: str, folds: int = 5, out: str = "score") -> DataFrame:
    """df with scores of models that saw none of the row's group; folds are by hash of the group."""
    x = df.withColumn("__fold", fold(group, folds))
    parts = []
    for k in range(folds):
        model, how = logistic(x.filter(F.col("__fold") != k), features, label)
        parts.append(score(x.filter(F.col("__fold") == k), model, how, out))
    return reduce(DataFrame.unionByName, parts).drop("__fold")


def poisson(df: DataFrame, features: list[str], count: str) -> dict[str, float]:
    """Coefficients of an unpenalised Poisson regression (log link) on scaled features."""
    x = scaled(df, moments(df, features)).withColumn("__n", F.col(count).cast("double"))
    m = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="__n", regParam=0.0, maxIter=50).fit(x)
    return {"intercept": float(m.intercept), **dict(zip(features, map(float, m.coefficients), strict=True))}


def one_hot(df: DataFrame, column: str, levels: int) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level 1..levels - 1 of a code, level 0 being the base; their names."""
    names = [f"{column}_{k}" for k in range(1, levels)]
    return df.select("*", *((F.col(column) == k).cast("double").alias(n) for k, n in enumerate(names, 1))), names


def poisson_draws(df: DataFrame, features: list[str], count: str, group: str, draws: int, seed: str, steps: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """draw, term, coefficient: an unpenalised Poisson regression (log link) refitted on every bootstrap draw of the groups.

    All draws are fitted at once by reweighted least squares. A step reads the rows once; a task adds up, for all draws,
    the weighted products of features (the rows' weights are how often their group was drawn), and the driver solves
    a system of the number of features for each draw. Rows carry the draws of their group, so a group of many rows
    isn't gathered anywhere.
    """
    groups = numbered(df.select(group).filter(F.col(group).isNotNull()).distinct(), [group], "k")
    slots = groups.crossJoin(F.broadcast(groups.agg(F.count("*").alias("__n")))).withColumn("draw", resample.draws(draws))
    taken = slots.select("draw", F.floor(resample.uniform(seed, "draw", "k") * F.col("__n")).cast("long").alias("k"))
    taken = taken.groupBy("k").agg(F.collect_list(F.col("draw").cast("int")).alias("drawn")).join(groups, "k").select(group, "drawn")
    x = df.select(group, *(F.col(f).cast("double").alias(f"__x{n}") for n, f in enumerate(features)), F.col(count).cast("double").alias("__y"))
    x = settled(x.join(taken, group).drop(group))
    p = len(features) + 1
    upper = np.triu_indices(p)

    def sums(beta: np.ndarray) -> np.ndarray:
        """For each draw: the weighted products of features, the gradient, and the draw's rows and counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((draws, len(upper[0]) + p + 2))
            for b in batches:
                m = b.num_rows
                drawn = b.column(p)
                row = np.repeat(np.arange(m), np.diff(drawn.offsets.to_numpy()))
                times = np.bincount(row * draws + drawn.flatten().to_numpy(), minlength=m * draws).reshape(m, draws).astype(np.float64)
                z = np.column_stack([np.ones(m), *(b.column(k).to_numpy() for k in range(p - 1))])
                y = b.column(p - 1).to_numpy()
                mu = np.exp(np.clip(z @ beta.T, -30, 30))
                total[:, : len(upper[0])] += (times * mu).T @ (z[:, upper[0]] * z[:, upper[1]])
                total[:, -p - 2 : -2] += (times * (y[:, None] - mu)).T @ z
                total[:, -2] += times.sum(axis=0)
                total[:, -1] += times.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = x.mapInArrow(run, "sums binary").rdd
        if not parts.getNumPartitions():
            return np.zeros((draws, len(upper[0]) + p + 2))
        return parts.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add).reshape(draws, -1)

    beta = np.zeros((draws, p))
    first = sums(beta)
    beta[:, 0] = np.log(np.maximum(first[:, -1], 0.5) / np.maximum(first[:, -2], 1))
    for _ in range(steps):
        s = sums(beta)
        h = np.zeros((draws, p, p))
        h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = s[:, : len(upper[0])]
        step = np.stack([np.linalg.lstsq(a, g, rcond=1e-12)[0] for a, g in zip(h, s[:, -p - 2 : -2], strict=True)])
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < tolerance:
            break
    rows = [(d, t, float(b)) for d in range(draws) for t, b in zip(["intercept", *features], beta[d], strict=True)]
    return df.sparkSession.createDataFrame(rows, "draw long, term string, coefficient double")


def svd(rows: DataFrame, id_: str, key: str, weight: str, k: int) -> DataFrame:
    """id, v: rows of a long sparse matrix (id, key, weight) on its k leading right directions, unit length. The matrix of keys by keys' directions is k wide."""
    size = rows.agg(F.max(key)).first()[0]
    grouped = rows.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct(key, weight))).alias("e"))
    n = (size or 0) + 1
    if n > 20_000:
        raise ValueError("hash the keys into fewer columns first")
    matrix = RowMatrix(grouped.rdd.map(lambda r: Vectors.sparse(n, [x[0] for x in r["e"]], [x[1] for x in r["e"]])))
    if n <= GRAM:  # one pass over the rows; the iterations of computeSVD would each read them again
        values, vectors = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
        values, vectors = np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]
        v = vectors[:, :k][:, values[:k] > 1e-9 * values[0]].tolist()
    else:
        v = matrix.computeSVD(k, computeU=False).V.toArray().tolist()
    basis = rows.sparkSession.createDataFrame([(i, row) for i, row in enumerate(v)], f"{key} int, b array<double>")
    x = rows.join(F.broadcast(basis), key).select(id_, F.posexplode("b").alias("p", "b"), weight)
    x = x.groupBy(id_, "p").agg(F.sum(F.col(weight) * F.col("b")).alias("c")).groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("p", "c"))).alias("c"))
    return x.select(id_, unit(F.transform("c", lambda s: s["c"])).alias("v"))

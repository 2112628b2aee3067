"""Interface of text encoders and pair scorers: any function of a list of texts, or of two matrices, run in batches.

Models themselves are passed in; a hashed encoder that needs no weights is functions.text.hashed_ngrams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import settled
from .rank import midranks
from .vectors import knn


def encoded(texts: DataFrame, id_: str, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """id, v: each distinct text is encoded once, in batches of like length, and joined back to its rows."""
    keyed = texts.select(id_, F.sha2(text, 256).alias("h"), text).filter(F.col(text).isNotNull())
    distinct = keyed.groupBy("h").agg(F.first(text).alias("t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.iloc[np.argsort(pdf["t"].str.len().to_numpy(), kind="stable")]
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"h": part["h"], "v": [np.asarray(x, float) for x in encode(part["t"].tolist())]})

    return keyed.select(id_, "h").join(distinct.mapInPandas(run, "h string, v array<double>"), "h").select(id_, "v")


def pooled(texts: DataFrame, id_: str, text: str, tokens: Callable[[str], list[int]], encode: Callable[[list[list[int]]], np.ndarray], window: int = 254, batch: int = 64) -> DataFrame:
    """id, v: mean of a text's token windows, each weighing its number of tokens, to unit length.

    encode gives the mean vector of each of up to `batch` windows; windows of all texts of an Arrow batch share its calls,
    like lengths together. A text without tokens is an error; null texts are left out.
    """
    kind = dict(texts.dtypes)[id_]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids = [tokens(t) for t in pdf[text]]
            if not all(map(len, ids)):
                raise ValueError("a text has no tokens")
            cut = [(row, x[at : at + window]) for row, x in enumerate(ids) for at in range(0, len(x), window)]
            cut.sort(key=lambda c: len(c[1]))
            total = None
            for at in range(0, len(cut), batch):
                part = cut[at : at + batch]
                v = np.asarray(encode([w for _, w in part]), float)
                total = np.zeros((len(ids), v.shape[1])) if total is None else total
                np.add.at(total, [row for row, _ in part], v * np.array([[len(w)] for _, w in part]))
            if total is not None:
                mean = total / np.array([[len(x)] for x in ids])
                yield pd.DataFrame({id_: pdf[id_], "v": list(mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12))})

    return texts.select(id_, text).filter(F.col(text).isNotNull()).mapInPandas(run, f"`{id_}` {kind}, v array<double>")


def reranked(pairs: DataFrame, vectors: DataFrame, predict: Callable[[np.ndarray, np.ndarray], np.ndarray], top: int = 10_000) -> DataFrame:
    """The `top` pairs (i, j) by score, with novelty, reach and novel, the mean of the average ranks of all three.

    predict says from the vectors (id, u; unit length) of a pair where what joins the two would lie, as a unit vector.
    novelty is its distance (1 - cosine) from the nearest item but the two, reach that from the nearer of the two. Only
    the pairs that the first score leaves are predicted and meet the items, block by block.
    """
    first = settled(pairs.select("i", "j", "score").orderBy(F.desc("score"), "i", "j").limit(top).withColumn("pair", F.monotonically_increasing_id()))
    x = first.join(vectors.select("id", "u").toDF("i", "ui"), "i").join(vectors.select("id", "u").toDF("j", "uj"), "j")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                a, b = np.stack(pdf["ui"].to_numpy()), np.stack(pdf["uj"].to_numpy())
                p = np.asarray(predict(a, b), float)
                yield pd.DataFrame({"id": pdf["pair"], "u": list(p), "reach": 1 - np.maximum((p * a).sum(1), (p * b).sum(1))})

    made = settled(x.select("pair", "ui", "uj").mapInPandas(run, "id long, u array<double>, reach double"))
    # three items at least hold one that isn't of the pair; ids of pairs and items are told apart by their sign
    query = made.select((-1 - F.col("id")).alias("id"), "u")
    near = knn(vectors.select("id", "u"), query, 3).select((-1 - F.col("query")).alias("pair"), "id", "sim")
    near = near.join(first.select("pair", "i", "j"), "pair").filter("id <> i AND id <> j").groupBy("pair").agg((1 - F.max("sim")).alias("novelty"))
    y = first.join(made.select(F.col("id").alias("pair"), "reach"), "pair").join(near, "pair", "left")
    y = settled(y.withColumns({c: F.round(c, 9) for c in ("novelty", "reach")}))
    for c in ("score", "novelty", "reach"):
        y = midranks(y, c, f"__{c}")
    return y.select("i", "j", "score", "novelty", "reach", ((F.col("__score") + F.col("__novelty") + F.col("__reach")) / 3).alias("novel"))


def scored(pairs: DataFrame, vectors: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """pairs (i, j) with score(rows of i, rows of j). vectors: (id, v)."""
    x = pairs.join(vectors.toDF("i", "vi"), "i").join(vectors.toDF("j", "vj"), "j")
    kind = dict(pairs.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                s = score(np.stack(pdf["vi"].to_numpy()), np.stack(pdf["vj"].to_numpy()))
                yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "score": np.asarray(s, float)})

    return x.select("i", "j", "vi", "vj").mapInPandas(run, f"i {kind['i']}, j {kind['j']}, score double")


def ranking_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """anchor, changed, reversed: of two tables (anchor, id, distance) of the same pairs, whether the set of nearest ones changed, and how many pairs of ids were strictly reversed."""
    near = lambda df, name: df.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("x")).select("anchor", F.array_sort(F.transform(F.filter("x", lambda e: e["distance"] == F.col("x")[0]["distance"]), lambda e: e["id"])).alias(name))
    both = a.withColumnRenamed("distance", "da").join(b.withColumnRenamed("distance", "db"), ["anchor", "id"])
    p, q = both.toDF("anchor", "i", "ai", "bi"), both.toDF("anchor", "j", "aj", "bj")
    flips = p.join(q, "anchor").filter("i < j AND sign(ai - aj) * sign(bi - bj) < 0").groupBy("anchor").agg(F.count("*").alias("reversed"))
    out = near(a, "na").join(near(b, "nb"), "anchor").join(flips, "anchor", "left")
    return out.select("anchor", (F.col("na") != F.col("nb")).alias("changed"), F.coalesce("reversed", F.lit(0)).cast("long").alias("reversed"))

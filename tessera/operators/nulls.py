"""Null models of pairs that share endpoints, against a binned population of all pairs.

Positives are pairs (i, j) of numbered items. A draw moves the endpoints, each to one other item in all its pairs, so
who meets how many stays; pairs that leave the subset are dropped, those that fall together count once. A draw's AUC
needs no order of its own: with `place` (pairs of the population at larger bins, and half of those in the same one)
summed over k drawn pairs, AUC = (sum - k^2 / 2) / (k (total - k)).

Substitution is a hash of draw and endpoint. A permutation takes the order of such hashes, cut into classes of even
size by the hash itself, so no window holds a draw. Nulls of independent pairs take a bin by inverse CDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corpus as cp
from . import resample as rs
from .dictionary import numbered
from .rank import midranks

#: Fewest pairs that a draw has to keep.
LEAST = 10
#: Endpoints of a class of hashes, about, where they are put in order.
CLASS = 1 << 16
DRAWS = 20_000


def population(hist: DataFrame) -> DataFrame:
    """bin, n, below, place, total of a histogram (bin, n): as many rows as bins, whatever the population."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    x = hist.select("bin", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("below"), total.alias("total"))
    return x.withColumn("place", F.col("total") - F.col("below") - 0.5 * F.col("n"))


def auc_of(placed: Column, k: Column, total: Column) -> Column:
    return F.when((k >= 2) & (total - k >= 2), (placed - k * k / 2) / (k * (total - k)))


def observed(pairs: DataFrame, pop: DataFrame) -> DataFrame:
    """k, auc of pairs (i, j, bin)."""
    x = pairs.join(F.broadcast(pop), "bin")
    s = x.agg(F.count("*").alias("k"), F.sum("place").alias("s"), F.max("total").alias("t"))
    return s.select("k", auc_of(F.col("s"), F.col("k"), F.col("t")).alias("auc"))


def endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("i").alias("e")).union(pairs.select("j")).distinct()


def _wired(pairs: DataFrame, xi: Column, xj: Column, once: bool) -> DataFrame:
    moved = pairs.select("draw", F.least(xi, xj).alias("i"), F.greatest(xi, xj).alias("j")).filter("i <> j")
    return moved.distinct() if once else moved


def substituted(pairs: DataFrame, items: int, draws: int, seed: str, once: bool = True) -> DataFrame:
    """draw, i, j: every endpoint is any of `items` items, the same in all its pairs of a draw. once: pairs that fall together are one row."""
    to = lambda c: F.floor(rs.uniform(seed, "draw", c) * items)
    # dealt out first: a short table lies in few tasks, and its draws would
    dealt = pairs.select("i", "j").repartition(3 * pairs.sparkSession.sparkContext.defaultParallelism, "i", "j")
    return _wired(dealt.withColumn("draw", rs.draws(draws)), to("i"), to("j"), once)


def slots(points: DataFrame, draws: int, seed: str, size: int = CLASS) -> DataFrame:
    """draw, e, slot: every draw's order of the points e, by hash, from 0."""
    classes = max(1, -(-points.count() // size))
    # dealt out first, as in substituted
    dealt = points.repartition(3 * points.sparkSession.sparkContext.defaultParallelism, "e")
    x = dealt.withColumn("draw", rs.draws(draws)).withColumn("u", rs.uniform(seed, "draw", "e"))
    x = x.withColumn("c", F.floor(F.col("u") * classes))
    sizes = x.groupBy("draw", "c").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("draw").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("draw", "c").orderBy("u", "e")) - 1
    # merged, here and where slots meet others: a table that looks small before its draws are spelled out would be broadcast
    x = x.withColumn("at", at).join(before.select("draw", "c", "before").hint("merge"), ["draw", "c"])
    return x.select("draw", "e", (F.col("before") + F.col("at")).alias("slot"))


def permutation(points: DataFrame, draws: int, seed: str, size: int = CLASS) -> DataFrame:
    """draw, e, to: in every draw the points e change places among themselves."""
    own = numbered(points.select(F.col("e").alias("to")), ["to"], "slot")
    return slots(points.select("e"), draws, seed, size).join(own.hint("merge"), "slot").select("draw", "e", "to")


def label_permutation(items: DataFrame, draws: int, seed: str, size: int = CLASS) -> DataFrame:
    """draw, auc where as many items as are positive, the first in the draw's order, count as positive. items: (id, s, y).

    Ranks stay as they are, so a draw is a sum of average ranks, not an order of its own.
    """
    ranked = midranks(items.select(F.col("id").alias("e"), "s"), "s", "__rank").select("e", "__rank")
    n = items.agg(F.count("*").alias("n"), F.count_if("y").alias("k"))
    x = slots(items.select(F.col("id").alias("e")), draws, seed, size).crossJoin(F.broadcast(n)).filter("slot < k").join(ranked.hint("merge"), "e")
    s = x.groupBy("draw").agg(F.sum("__rank").alias("r"), F.max("k").alias("k"), F.max("n").alias("n"))
    k, rest = F.col("k"), F.col("n") - F.col("k")
    return s.select("draw", F.when(rest > 0, (F.col("r") - k * (k + 1) / 2) / (k * rest)).alias("auc"))


def permuted(pairs: DataFrame, draws: int, seed: str, size: int = CLASS, once: bool = True) -> DataFrame:
    """draw, i, j: the endpoints of the pairs change places among themselves. once: as in substituted."""
    to = permutation(endpoints(pairs), draws, seed, size)
    x = pairs.select("i", "j").join(to.toDF("draw", "i", "xi").hint("merge"), "i").join(to.toDF("draw", "j", "xj").hint("merge"), ["draw", "j"])
    return _wired(x, F.col("xi"), F.col("xj"), once)


def scored(drawn: DataFrame, corpus: DataFrame, pop: DataFrame, subset: str, width: float, least: int = LEAST, count: int | None = None, groups: int | None = None) -> DataFrame:
    """draw, k, auc of the draws that keep enough pairs in the subset; pairs of a draw that fall together count once.

    count: how many pairs all draws have, about. A task finds the pairs of two groups of items and gives sums for each draw.
    """
    at, place, total, _ = _bins(pop)

    def run(wanted: pd.DataFrame, bins: np.ndarray, *flags: np.ndarray) -> pd.DataFrame:
        spot = np.searchsorted(at, bins)
        ok = cp.masks(*flags)[subset] & (spot < len(at))
        ok[ok] = at[spot[ok]] == bins[ok]
        x = wanted[["draw", "i", "j"]].assign(place=np.append(place, 0.0)[spot])[ok].drop_duplicates(["draw", "i", "j"])
        return x.groupby("draw", as_index=False).agg(k=("place", "size"), s=("place", "sum"))

    few = subset in ("low", "hard")
    s = cp.features_at(corpus, drawn.select("draw", "i", "j"), run, "draw long, k long, s double", width, few=few, count=count, groups=groups)
    s = s.groupBy("draw").agg(F.sum("k").alias("k"), F.sum("s").alias("s")).filter(F.col("k") >= least)
    return s.select("draw", "k", auc_of(F.col("s"), F.col("k"), F.lit(total)).alias("auc"))


def _bins(pop: DataFrame) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """bin, place, total and upto (pairs up to the bin) of a population; bins are of a fixed number."""
    rows = pop.orderBy("bin").select("bin", "below", "n", "place", "total").collect()
    of = lambda f, kind: np.array([f(r) for r in rows], kind)
    return of(lambda r: r["bin"], np.int64), of(lambda r: r["place"], float), rows[0]["total"] if rows else 0, of(lambda r: r["below"] + r["n"], np.int64)


def independent(sizes: DataFrame, pop: DataFrame, seed: str, chunk: int = CLASS) -> DataFrame:
    """draw, auc of as many independent pairs of the population as sizes (draw, k) says; a draw is spelled out in chunks, in several tasks."""
    _, place, total, upto = _bins(pop)

    @F.pandas_udf("double")
    def at(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for u in parts:
            yield pd.Series(place[np.searchsorted(upto, np.floor(u.to_numpy() * total), side="right")])

    first = F.sequence(F.lit(1).cast("long"), F.col("k"), F.lit(chunk).cast("long"))
    x = sizes.filter("k > 0").select("draw", F.col("k").cast("long").alias("k")).withColumn("p", F.explode(first))
    x = x.repartition(8 * sizes.sparkSession.sparkContext.defaultParallelism, "draw", "p")
    x = x.select("draw", "k", F.explode(F.sequence("p", F.least(F.col("p") + (chunk - 1), "k"))).alias("p"))
    s = x.withColumn("place", at(rs.uniform(seed, "draw", "p"))).groupBy("draw").agg(F.max("k").alias("k"), F.sum("place").alias("s"))
    return s.select("draw", auc_of(F.col("s"), F.col("k"), F.lit(total)).alias("auc"))


def summary(real: DataFrame, null: DataFrame, matched: DataFrame, at_size: DataFrame) -> DataFrame:
    """One row: the observed k and auc (real), and what a null (draw, k, auc) says of it.

    inflation: its spread over that of independent pairs of the same sizes (matched); sd: that, at the observed size
    (at_size); n_eff: independent pairs of that spread; sigma, p: how far the observed AUC lies out, by sd and by draws.
    """
    spread = lambda df, name: df.agg(F.stddev_pop("auc").alias(name))
    n = null.agg(F.count("*").alias("draws"), F.avg("k").alias("kept"), F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd_null"))
    x = real.crossJoin(n).crossJoin(spread(matched, "sd_matched")).crossJoin(spread(at_size, "sd_at_size"))
    x = x.withColumn("inflation", F.when(F.col("sd_matched") > 0, F.col("sd_null") / F.col("sd_matched")))
    x = x.withColumn("sd", F.col("inflation") * F.col("sd_at_size"))
    x = x.withColumn("n_eff", F.when(F.col("sd") > 0, 1 / (12 * F.col("sd") * F.col("sd")))).withColumn("sigma", F.when(F.col("sd") > 0, (F.col("auc") - F.col("mean")) / F.col("sd")))
    z = null.select("auc").withColumnRenamed("auc", "drawn").crossJoin(F.broadcast(x.select("mean", "sd_null", "sigma")))
    p = z.agg(F.avg(((F.col("drawn") - F.col("mean")) / F.col("sd_null") >= F.col("sigma")).cast("double")).alias("p"))
    return x.crossJoin(p).select("k", "auc", "draws", "kept", "mean", "sd_null", "inflation", "sd", "n_eff", "sigma", "p")


def without(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs that touch none of points (e)."""
    p = points.select("e")
    return pairs.join(p.toDF("i"), "i", "left_anti").join(p.toDF("j"), "j", "left_anti").select(*pairs.columns)


def hubs(pairs: DataFrame, share: float) -> DataFrame:
    """e: the endpoints of at least `share` of the pairs."""
    degree = pairs.select(F.col("i").alias("e")).union(pairs.select("j")).groupBy("e").agg(F.count("*").alias("deg"))
    return degree.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("__n")))).filter(F.col("deg") >= F.col("__n") * share).select("e")

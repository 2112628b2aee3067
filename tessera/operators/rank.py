"""Tie-averaged ranking statistics: mid-ranks, AUC (plain, weighted, stratified), placements, lift.

Cumulative sums over one global order would put all rows in one task. `cumulative` cuts the order at
approximate quantiles into buckets instead, sums within each, and adds the sums of the buckets before; any
cut gives the same result, so the quantiles need not be exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled

BUCKETS = 64


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucketed(df: DataFrame, order: str, buckets: int = BUCKETS) -> DataFrame:
    """df with __b, which rises with `order`; nulls have no bucket."""
    edges = df.agg(F.percentile_approx(F.col(order).cast("double"), F.lit([k / buckets for k in range(1, buckets)])).alias("__edges"))
    b = F.size(F.filter("__edges", lambda e: e <= F.col(order).cast("double")))
    return df.crossJoin(F.broadcast(edges)).withColumn("__b", b).drop("__edges")


def cumulative(df: DataFrame, order: str, values: list[str], by: list[str] | None = None, suffix: str = "_below") -> DataFrame:
    """For each value column, the sum over rows with a smaller `order` within `by`; rows of df are unique in (by, order)."""
    by = by or []
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v + suffix) for v in values))
    cut = bucketed(df, order)
    inner = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("__b").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    before = totals.select("__b", *(F.coalesce(F.sum(f"__{v}").over(outer), F.lit(0)).alias(f"__{v}") for v in values))
    out = cut.select("*", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(v + suffix) for v in values)).join(F.broadcast(before), "__b")
    return out.select(*df.columns, *((F.col(v + suffix) + F.col(f"__{v}")).alias(v + suffix) for v in values))


def classes(df: DataFrame, score: str, positive: str, weight: str | Column | None = None, by: list[str] | None = None) -> DataFrame:
    """One row for each score (within by): weight of positives pw and of negatives nw, and the sums below it."""
    w = _col(weight) if weight is not None else F.lit(1.0)
    y = F.coalesce(F.col(positive), F.lit(False))
    by = by or []
    sums = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(y, w).otherwise(0.0)).alias("pw"), F.sum(F.when(y, 0.0).otherwise(w)).alias("nw"))
    return cumulative(sums, score, ["pw", "nw"], by)


def auc(df: DataFrame, score: str, positive: str, weight: str | Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; null without both classes. One row for each `by`."""
    c = classes(df, score, positive, weight, by)
    won, all_ = F.sum(F.col("pw") * (F.col("nw_below") + 0.5 * F.col("nw"))), F.sum("pw") * F.sum("nw")
    out = [F.when(all_ > 0, won / all_).alias("auc"), F.sum("pw").alias("positives"), F.sum("nw").alias("negatives")]
    return c.groupBy(*by).agg(*out) if by else c.agg(*out)


def stratified_auc(df: DataFrame, score: str, positive: str, strata: str, weight: str | Column | None = None) -> DataFrame:
    """Pooled AUC of pairs within one stratum."""
    c = classes(df, score, positive, weight, [strata])
    each = c.groupBy(strata).agg(F.sum(F.col("pw") * (F.col("nw_below") + 0.5 * F.col("nw"))).alias("won"), (F.sum("pw") * F.sum("nw")).alias("pairs"))
    return each.agg(F.when(F.sum("pairs") > 0, F.sum("won") / F.sum("pairs")).alias("auc"))


def placements(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Of each score that has positives, the share of negatives below it, ties counting half; n: how many positives."""
    by = by or []
    c = classes(df, score, positive, None, by)
    n = c.groupBy(*by).agg(F.sum("nw").alias("__n")) if by else c.agg(F.sum("nw").alias("__n"))
    c = c.join(F.broadcast(n), by) if by else c.crossJoin(F.broadcast(n))
    share = F.when(F.col("__n") > 0, (F.col("nw_below") + 0.5 * F.col("nw")) / F.col("__n"))
    return c.filter("pw > 0").select(*by, score, share.alias("placement"), F.col("pw").alias("n"))


def midranks(df: DataFrame, score: str, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with the average rank, from 1, of its score (within by)."""
    by = by or []
    n = df.groupBy(*by, score).agg(F.count("*").alias("__n"))
    c = cumulative(n, score, ["__n"], by)
    rank = F.col("__n_below") + (F.col("__n") + 1) / 2
    return df.join(c.select(*by, score, rank.alias(out)), [*by, score])


def top_k(df: DataFrame, score: str, ids: list[str], k: int) -> DataFrame:
    """The k largest scores, ties by id."""
    return df.orderBy(F.desc(score), *ids).limit(k)


def top_per(df: DataFrame, group: str, score: str, ids: list[str], k: int) -> DataFrame:
    """The k largest scores of each group with rank, ties by id."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *ids)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def quantiles(df: DataFrame, value: str, cuts: list[float], interpolate: bool = True, out: str = "edges") -> DataFrame:
    """One row: the values at the quantiles `cuts`, linear between two rows (interpolate) or the first row to reach them; empty without values.

    From counts of distinct values and the sums below them, so no task holds all values.
    """
    counts = settled(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n").alias("__t"))
    at = lambda q: F.lit(float(q)) * (F.col("__t") - 1) if interpolate else F.greatest(F.ceil(F.lit(float(q)) * F.col("__t")) - 1, F.lit(0)).cast("double")
    places = total.filter("__t > 0").select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), at(q).alias("h")) for k, q in enumerate(cuts)))).alias("p")).select("p.*")
    low, high = F.floor("h"), F.ceil("h")
    holds = lambda place: (F.col("__n_below") <= place) & (place < F.col("__n_below") + F.col("__n"))
    met = cumulative(counts, "__v", ["__n"]).join(F.broadcast(places), holds(low) | holds(high))
    each = met.groupBy("k").agg(F.max(F.when(holds(low), F.col("__v"))).alias("a"), F.max(F.when(holds(high), F.col("__v"))).alias("b"), F.max("h").alias("h"))
    each = each.select("k", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("e"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias(out))


def quantile_band(df: DataFrame, value: str, cuts: list[float], out: str = "band") -> DataFrame:
    """Number of quantile edges (linear interpolation) at or below the value."""
    edges = quantiles(df, value, cuts, out="__e")
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.size(F.filter("__e", lambda e: e <= F.col(value))).cast("long")).drop("__e")

"""Hash-seeded draws, bootstraps, nulls and corrections.

A draw is a function of (seed, draw, key), so any engine, partitioning or retry gives the same one. Draws
multiply small grouped tables, never the rows themselves: statistics come from per-group sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: str, *keys: str | Column) -> Column:
    """A number in [0, 1) from SHA-256 of seed and keys, 32 bits."""
    text = F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draws(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows first in the order of SHA-256 of seed and key."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def multiplicities(groups: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """draw, key, mult: as many draws with replacement of the groups as there are groups, n times. groups: one row for each key, numbered from 0 in column k."""
    total = groups.agg(F.count("*").alias("__n"))
    x = groups.select(F.col("k").alias("slot")).crossJoin(F.broadcast(total)).withColumn("draw", draws(n))
    x = x.withColumn("k", F.floor(uniform(seed, "draw", "slot") * F.col("__n")).cast("long"))
    return x.groupBy("draw", "k").agg(F.count("*").alias("mult")).join(F.broadcast(groups.select(key, "k")), "k").select("draw", key, "mult")


def numbered(groups: DataFrame, key: str) -> DataFrame:
    """groups numbered from 0 by key; groups are few, as the draws are over them."""
    return groups.select(key).distinct().withColumn("k", F.row_number().over(Window.orderBy(key)).cast("long") - 1)


def weighted_classes(classes: DataFrame, mult: DataFrame, group: str, score: str) -> DataFrame:
    """draw, score, pw, nw: class weights of each draw. classes: (group, score, pw, nw)."""
    x = classes.join(F.broadcast(mult), group)
    return x.groupBy("draw", score).agg(F.sum(F.col("pw") * F.col("mult")).alias("pw"), F.sum(F.col("nw") * F.col("mult")).alias("nw"))


def interval(values: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return values.agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))


def largest_remainder(sizes: DataFrame, stratum: str, n: str, total: int) -> DataFrame:
    """stratum, quota: shares of `total` in proportion to n; the largest remainders get what is left, ties by stratum."""
    all_ = sizes.agg(F.sum(n).alias("__t"))
    x = sizes.crossJoin(F.broadcast(all_)).withColumn("__q", F.col(n) * total / F.col("__t"))
    x = x.withColumn("quota", F.floor("__q").cast("long")).withColumn("__r", F.round(F.col("__q") - F.floor("__q"), 9))
    left = x.agg((F.lit(total) - F.sum("quota")).alias("__left"))
    place = F.row_number().over(Window.orderBy(F.desc("__r"), stratum))
    return x.crossJoin(F.broadcast(left)).select(stratum, (F.col("quota") + (place <= F.col("__left")).cast("long")).alias("quota"))


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """name, p, rejected: step-down correction; the first p above alpha / (m - k) and all after it stand."""
    w = Window.orderBy(p, name)
    x = tests.withColumn("__k", F.row_number().over(w) - 1).crossJoin(F.broadcast(tests.agg(F.count("*").alias("__m"))))
    ok = (F.col(p) <= alpha / (F.col("__m") - F.col("__k"))).cast("int")
    return x.withColumn("rejected", F.min(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).select(name, p, "rejected")


def verdict(estimate: Column, low: Column, n: Column, least: float, min_n: int) -> Column:
    """The order of the clauses is part of the result."""
    return F.when(n < min_n, "underpowered").when(low > least, "yes").when(low > 0, "small").when(estimate > 0, "unclear").otherwise("no")

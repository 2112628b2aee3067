"""Dense numbers for rows, names and tokens, without a window over all of them.

Rows are sorted by range over the partitions and written; a row's number is its place in its sorted run plus the sizes
of the runs before. Numbers follow the sorting keys alone, so any partitioning gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled


def in_order(df: DataFrame, keys: list) -> DataFrame:
    """df sorted over its partitions by keys, written; part and spot say where a row lies: its sorted run, and its place there."""
    runs = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("spot", F.monotonically_increasing_id())
    return settled(runs.withColumn("part", F.shiftright("spot", 33)).withColumn("spot", F.col("spot").bitwiseAND((1 << 33) - 1)))


def bases(runs: DataFrame, group: str | None = None) -> DataFrame:
    """part, base (and group), n: base + spot is a row's place among the n of its group, the first of the sorting keys.

    The window holds a row for each sorted run, not for each row.
    """
    names = [group] if group else []
    counts = runs.groupBy("part", *names).agg(F.count("*").alias("size"), F.min("spot").alias("low"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return settled(counts.select("part", *names, (F.coalesce(before, F.lit(0)) - F.col("low")).alias("base"), F.sum("size").over(whole).alias("n")))


def numbered(df: DataFrame, keys: list, out: str = "idx") -> DataFrame:
    """df with `out`, its place from 0 in the order of keys; rows that tie are numbered in any order."""
    runs = in_order(df, keys)
    return runs.join(bases(runs).select("part", "base"), "part").withColumn(out, F.col("base") + F.col("spot")).select(*df.columns, out)


def dictionary(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """key, out: the distinct values of a column, nulls apart, numbered from 0 in their order."""
    return numbered(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], out)


def encoded(df: DataFrame, key: str, codes: DataFrame, out: str = "idx", closed: bool = True) -> DataFrame:
    """df with the number of `key` among codes (key, out); closed: a value that has none ends the job with an error, and null has none."""
    x = df.join(codes.select(key, out), key, "left")
    if closed:
        unknown = F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        return x.withColumn(out, F.when(F.col(out).isNull(), F.raise_error(unknown).cast("long")).otherwise(F.col(out)))
    return x

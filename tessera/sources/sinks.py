"""Sinks, seals and comparisons of results."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task joins and counts, about, where tasks follow the rows.
ROWS = 1 << 19


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that must not exist yet; the committer makes it whole or absent."""
    df.write.mode("errorifexists").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir); a local folder only where that is unset and Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[\d*, ]+\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table in a scratch folder, where its lineage ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, rows: int) -> int:
    """Partitions for so many rows, ROWS at most in each, about, and no fewer than a shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "gzip").json(path)


def missing(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resume(spark: SparkSession, todo: DataFrame, path: str, key: str, run) -> DataFrame:
    """All of run(rows) for todo, appended to path for the keys that it doesn't hold yet."""
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # the path isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    run(missing(todo, done, key) if done is not None else todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def digest(df: DataFrame) -> DataFrame:
    """rows, seal: count and an order-free SHA-based checksum of a table; columns in alphabetical order."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("seal"))


def seals(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (digest(df).select(F.lit(name).alias("name"), "rows", "seal") for name, df in tables.items()))


def broken(before: DataFrame, now: DataFrame) -> DataFrame:
    """Names whose seal is missing on one side or differs."""
    x = before.withColumnRenamed("seal", "a").join(now.withColumnRenamed("seal", "b").select("name", "b"), "name", "full_outer")
    return x.filter(~F.col("a").eqNullSafe(F.col("b"))).select("name", "a", "b")


def differences(produced: DataFrame, committed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys, column, produced, committed: cells that differ by more than the tolerance, and rows that one side lacks."""
    values = [c for c in produced.columns if c not in keys]
    tall = lambda df, name: df.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.col(c).cast("string") for c in values)))).alias("column", name))
    x = tall(produced, "produced").join(tall(committed, "committed"), [*keys, "column"], "full_outer")
    gap = F.abs(F.expr("try_cast(produced AS double)") - F.expr("try_cast(committed AS double)"))
    return x.filter(~F.col("produced").eqNullSafe(F.col("committed")) & (gap.isNull() | (gap > tolerance)))

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.dictionary import bases, in_order  # noqa: F401
from ..sources.sinks import scratch


#: Bytes of an Arrow batch at most, but for a single longer row.
BATCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, whose results are written.

    They go when the driver collects the last reference: the first round frees the plans, the second what they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key `on` (longs) is among keys.

    The semi join is Spark's, and so is the runtime filter before it: where the keys are few, a Bloom filter of
    fixed size drops most other rows at the scan, so their texts don't move. Spark wants a comparison on the
    keys' side to think a filter worth its cost; this one is always true.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    some = written(keys.select(*on).distinct())
    return rows.join(some.filter(F.col(on[-1]) >= F.lit(-(1 << 63))), on, "left_semi")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """What a worker holds at once is bounded by bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def text_bytes(col: str = "text"):
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def with_columns_by(df: DataFrame, keep: list[str], inputs: dict, fn: Callable[..., list[list]], added: str, replace: bool = False, raw: bool = False) -> DataFrame:
    """Columns `keep` of df, passed through as they are, and the columns of the schema `added`.

    inputs: name -> Column, given to fn as lists by name for each Arrow batch (raw: as Arrow arrays); fn returns
    a list for each added column. With replace, an added column takes the place of a kept one of its name.
    """
    bounded_batches(df.sparkSession)
    new = T.StructType.fromDDL(added)
    wide = df.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(f"__in_{k}") for k, c in inputs.items()))
    kept = wide.schema.fields[: len(keep)]
    fields = [next((n for n in new if replace and n.name == f.name), f) for f in kept]
    fields += [n for n in new if not (replace and n.name in keep)]
    schema, names = T.StructType(fields), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            made = fn(**{k: b.column(f"__in_{k}") if raw else b.column(f"__in_{k}").to_pylist() for k in names})
            by_name = {n.name: x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n.name).type) for n, x in zip(new, made, strict=True)}
            cols = [by_name[f.name] if f.name in by_name else b.column(f.name).cast(arrow.field(f.name).type) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return wide.mapInArrow(run, schema)

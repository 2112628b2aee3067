"""Archives of vectors in chunks of .npy, with a manifest that says what they hold.

A chunk is read whole by Spark's binary reader, from any store that Spark reads, and is checked before a row of it is
given: it is there, its digest is the manifest's, its header says as many rows of the dimension as the manifest does.
A chunk is at most 2 GB, the bound of that reader; a task holds one.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY"
MANIFEST = "dimension long, records long, chunks array<struct<filename:string,rows:long,sha256:string>>"


def header_of(data: bytes) -> tuple[tuple[int, ...], str, bool, int]:
    """shape, kind of number, whether columns come first, and where the numbers of a .npy begin."""
    if data[:6] != MAGIC:
        raise ValueError("no .npy")
    width = 2 if data[6] == 1 else 4
    at = 8 + width
    end = at + int.from_bytes(data[8:at], "little")
    said = ast.literal_eval(data[at:end].decode("latin1"))
    return said["shape"], said["descr"], said["fortran_order"], end


def array_of(data: bytes, what: str) -> np.ndarray:
    """The numbers of a .npy; a file that is cut short or longer than it says, and objects, are refused."""
    shape, kind, by_columns, at = header_of(data)
    dtype = np.dtype(kind)
    if dtype.hasobject:
        raise ValueError(f"{what}: objects aren't read")
    if len(data) - at != dtype.itemsize * int(np.prod(shape)):
        raise ValueError(f"{what}: {len(data) - at} bytes for {shape} of {kind}")
    return np.frombuffer(data, dtype, offset=at).reshape(shape, order="F" if by_columns else "C")


def manifest(spark: SparkSession, root: str, name: str = "vector-manifest.json") -> DataFrame:
    """chunk, filename, first (the chunk's first row), rows, sha256, dimension; a manifest whose rows don't sum to its records is refused."""
    x = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/{name}")
    x = x.withColumn("__sum", F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["rows"]))
    wrong = F.raise_error(F.concat(F.lit("the manifest's chunks hold "), F.col("__sum").cast("string"), F.lit(" rows of "), F.col("records").cast("string")))
    x = x.withColumn("records", F.when(F.col("__sum") == F.col("records"), F.col("records")).otherwise(wrong.cast("long")))
    first = F.aggregate(F.slice("chunks", 1, F.col("chunk")), F.lit(0).cast("long"), lambda s, c: s + c["rows"])
    each = x.select("dimension", "records", "chunks", F.posexplode("chunks").alias("chunk", "c")).filter("records >= 0")
    return each.select("chunk", "c.filename", first.alias("first"), "c.rows", "c.sha256", "dimension")


def array_rows(spark: SparkSession, root: str, name: str = "vector-manifest.json") -> DataFrame:
    """idx, vec: the rows of an archive in the order of its chunks, all of them checked."""
    want = manifest(spark, root, name)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    x = want.join(files, "filename", "left")
    fault = (
        F.when(F.col("content").isNull(), "missing chunk: ")
        .when(F.col("sha256").isNull() | (F.sha2("content", 256) != F.lower("sha256")), "changed chunk: ")
    )
    x = x.withColumn("content", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, "filename")).cast("binary")).otherwise(F.col("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                what, first, rows, dim = (b.column(c)[k].as_py() for c in ("filename", "first", "rows", "dimension"))
                a = array_of(b.column("content")[k].as_py(), what)
                if a.shape != (rows, dim):
                    raise ValueError(f"{what}: {a.shape} where the manifest says {(rows, dim)}")
                for at in range(0, rows, 8192):
                    part = np.ascontiguousarray(a[at : at + 8192], np.float64)
                    vec = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * dim, pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(part))), vec], names=["idx", "vec"])

    return x.select("filename", "first", "rows", "dimension", "content").mapInArrow(run, "idx long, vec array<double>")


def array_faults(spark: SparkSession, root: str, name: str = "vector-manifest.json") -> DataFrame:
    """filename, fault (missing, changed, unlisted) of an archive's chunks, without reading their numbers."""
    want = manifest(spark, root, name).select("filename", "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("found"))
    x = want.join(files, "filename", "full_outer")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.lower("sha256") != F.col("found"), "changed")
    return x.select("filename", fault.alias("fault")).filter("fault IS NOT NULL")

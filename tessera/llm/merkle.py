"""Merkle manifest of a data set: an external-memory node store of sorted runs, and proofs scanned out of it.

A row is a leaf; a tree for each language holds its leaves in the order of doc_id, and one more tree holds the
subroots in the order of the languages. FAN consecutive nodes of a level form a run, whose hash is a node of the next.

* Leaves are hashed once and written, sorted by range, and written again with their places (`common.placed`): no
  window and no task holds a language.
* The store is one folder, partitioned by level. A level is made by reading the one below in its order, batch by
  batch; runs that a batch or a file split cuts are written in parts and put together when they are read (a part for
  each end of a batch, so their number follows the batches).
* Proofs come from the top down. A run is joined by its coordinate (tree, run) with the run of the level above that
  holds its node, whose path is known; so paths travel once for each FAN * FAN leaves, and siblings are only taken
  apart where they are hashed.

Defined results: a null field is hashed as `-`; null languages form a tree of their own, before all others; within a
language null doc_ids come first, and rows of one doc_id are ordered by their leaves. Repeated rows are leaves each.
An altered copy of a row with a null doc_id isn't checked in the query (it counts as untampered). A single row is its
own subroot and root, and its proof is the hash of nothing. An empty table gives an empty result. Other columns are
ignored. Texts are hashed whole, inside the JVM, one row at a time, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest.
WIDTH = 32

RUN = "tree long, run long, n long, first long, whole boolean, kids binary"
PAYLOAD = "doc_ids array<long>, altered array<binary>"


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Binary sha256 of parts together."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf(**instead: Column) -> Column:
    return digest(*(field(instead.get(f, F.col(f))) for f in FIELDS))


def _batch_runs(b: pa.RecordBatch, fan: int, payload: bool) -> pa.RecordBatch:
    """The runs of a batch of nodes; neighbours of one run share the batch's buffer, so nothing is copied."""
    tree, idx, n = (b.column(c).to_numpy() for c in ("tree", "idx", "n"))
    run = idx // fan
    new = np.ones(len(idx), bool)
    new[1:] = (tree[1:] != tree[:-1]) | (run[1:] != run[:-1]) | (idx[1:] != idx[:-1] + 1)
    at = np.flatnonzero(new)
    ends = np.append(at, len(idx)).astype(np.int32)
    nodes = pa.array(b.column("digest"), pa.binary())
    data = nodes.buffers()[2].slice(WIDTH * nodes.offset) if len(nodes) else pa.py_buffer(b"")
    kids = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends * WIDTH), data])
    size = np.minimum(fan, n[at] - run[at] * fan)
    columns = [pa.array(tree[at]), pa.array(run[at]), pa.array(n[at]), pa.array(idx[at]), pa.array(np.diff(ends) == size), kids]
    names = ["tree", "run", "n", "first", "whole", "kids"]
    if payload:
        columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(b.column(c))) for c in ("doc_id", "altered")]
        names += ["doc_ids", "altered"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def runs(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """nodes (tree, idx, n nodes of that tree, digest; doc_id and altered as well for leaves) -> their runs, in order, with `whole` false for parts."""
    payload = "altered" in nodes.columns

    def run(batches):
        for b in batches:
            yield _batch_runs(b, fan, payload)

    names = ["tree", "idx", "n", "digest", *(["doc_id", "altered"] if payload else [])]
    return nodes.select(*names).mapInArrow(run, RUN + (f", {PAYLOAD}" if payload else ""))


def level(spark: SparkSession, store: str, k: int) -> DataFrame:
    """Level k of the store: its whole runs as they lie there, and those put together from parts."""
    rows = spark.read.schema(RUN + (f", {PAYLOAD}" if k == 0 else "")).parquet(f"{store}/level={k}")
    lists = ["doc_ids", "altered"] if k == 0 else []
    cut = rows.filter("NOT whole").groupBy("tree", "run").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("first", "kids", *lists))).alias("parts"))
    kids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["kids"]))
    joined = cut.select("tree", "run", "n", kids.alias("kids"), *(F.flatten(F.col(f"parts.{c}")).alias(c) for c in lists))
    return rows.filter("whole").select("tree", "run", "n", "kids", *lists).unionByName(joined)


def above(run_rows: DataFrame, fan: int = FAN) -> DataFrame:
    """The nodes that the runs of a level are on the next one; a tree's single node has none above it."""
    return run_rows.filter("n > 1").select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / fan).alias("n"), digest(hexed(F.col("kids"))).alias("digest"))


def build(leaves: DataFrame, most: int, store: str, fan: int = FAN) -> list[DataFrame]:
    """Writes every level of the trees over leaves (at most `most` in a tree) to the store; the levels' runs."""
    spark, levels, nodes = leaves.sparkSession, [], leaves
    while True:
        runs(nodes, fan).write.parquet(f"{store}/level={len(levels)}")
        levels.append(level(spark, store, len(levels)))
        most = -(-most // fan)
        if most <= 1:
            return levels
        nodes = above(levels[-1], fan)


def tops(levels: list[DataFrame], fan: int = FAN) -> DataFrame:
    """tree, top: the digest that remains of each tree."""
    lone = levels[0].filter("n = 1").select("tree", F.col("kids").alias("top"))
    ends = [x.filter(F.col("n").between(2, fan)).select("tree", digest(hexed(F.col("kids"))).alias("top")) for x in levels]
    out = lone
    for x in ends:
        out = out.unionByName(x)
    return out


def _step(kids: Column, j: Column) -> Column:
    """The siblings left and right of child j, as hex text."""
    j = j.cast("int")
    left = F.substr(kids, F.lit(1), j * WIDTH)
    return F.struct(hexed(left).alias("left"), hexed(F.substr(kids, j * WIDTH + WIDTH + 1)).alias("right"))


def with_paths(levels: list[DataFrame], seeds: DataFrame, fan: int = FAN) -> DataFrame:
    """Leaf runs with `path`, the siblings of their nodes level by level, and what seeds (tree, path, ...) know of their tree."""
    extra, up = [c for c in seeds.columns if c != "tree"], None
    for rows in reversed(levels):
        found = rows.filter(f"n <= {fan}").join(seeds, "tree")
        if up is not None:
            upper = up.select("tree", F.col("run").alias("up"), F.col("kids").alias("up_kids"), *extra)
            rest = rows.filter(f"n > {fan}").withColumn("up", F.floor(F.col("run") / fan)).join(upper, ["tree", "up"])
            path = F.concat(F.array(_step(F.col("up_kids"), F.col("run") % fan)), "path")
            found = found.unionByName(rest.withColumn("path", path).drop("up", "up_kids"))
        up = found
    return up


def members(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each leaf of the runs: `keep`, idx, digest and its path from its own siblings on; doc_id and altered if the runs have them."""
    j, payload = F.col("j"), "doc_ids" in rows.columns
    at = F.explode(F.expr(f"sequence(0, octet_length(kids) div {WIDTH} - 1)")).alias("j")
    each = rows.select("*", at)
    own = F.when(F.col("n") > 1, F.array(_step(F.col("kids"), j))).otherwise(F.array().cast(STEPS))
    return each.select(
        *keep,
        (F.col("run") * FAN + j).alias("idx"),
        F.substr("kids", j.cast("int") * WIDTH + 1, F.lit(WIDTH)).alias("digest"),
        F.concat(own, "path").alias("path"),
        *([F.get("doc_ids", j).alias("doc_id"), F.get("altered", j).alias("altered")] if payload else []),
    )


STEPS = "array<struct<left:string,right:string>>"


def folded(start: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf (hex text) and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


@dataclass
class Manifest:
    """store: the folder of the documents' node store (None for an empty table); proofs: doc_id, altered, leaf, subroot (binary), path."""

    store: str | None
    root: str | None
    proofs: DataFrame


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The Merkle manifest of docs (doc_id, source, lang, n_chars, text).

    altered: the leaf of a changed copy of the row, to be checked against the row's proof; null where there is none.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    hashed = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), (F.lit(None).cast("binary") if altered is None else altered).alias("altered"))
    leaves = common.in_order(common.written(hashed), ["lang", "doc_id", "digest", "altered"])
    counts = common.bases(leaves, "lang")
    # the trees are numbered in the order of their languages, and are the leaves of the tree above them
    langs = common.in_order(counts.groupBy("lang").agg(F.first("n").alias("n")), ["lang"])
    trees = common.written(langs.join(common.bases(langs).select("part", "base"), "part").select("lang", (F.col("base") + F.col("spot")).alias("tree"), "n"))
    count, most = trees.agg(F.count("*"), F.max("n")).first()
    if not count:
        none = hashed.filter("false").withColumnRenamed("digest", "leaf")
        return Manifest(None, None, none.select("doc_id", "altered", "leaf", F.col("leaf").alias("subroot"), F.array().cast(STEPS).alias("path")))
    # a row's place comes with the counts of its sorted run, so no language is a join key of all its rows
    known = counts.alias("c").join(trees.alias("t"), F.expr("c.lang <=> t.lang")).select("c.part", "c.lang", "c.base", "t.tree", "t.n")
    placed = leaves.alias("l").join(common.written(known).alias("k"), F.expr("l.part = k.part AND l.lang <=> k.lang"))
    nodes = placed.select("k.tree", F.expr("k.base + l.spot").alias("idx"), "k.n", "l.digest", "l.doc_id", "l.altered")
    levels = build(nodes, most, f"{folder}/documents")
    subroots = tops(levels)
    upper = common.written(subroots).repartitionByRange("tree").sortWithinPartitions("tree")
    number = F.col("tree")
    upper = upper.select(F.lit(0).cast("long").alias("tree"), number.alias("idx"), F.lit(count).cast("long").alias("n"), F.col("top").alias("digest"), number.alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
    crown = build(upper, count, f"{folder}/trees")
    root = tops(crown).first()["top"].hex()
    start = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(STEPS).alias("path"))
    seeds = common.written(members(with_paths(crown, start), []).select(F.col("doc_id").alias("tree"), "path", F.col("digest").alias("subroot")))
    found = members(with_paths(levels, seeds), ["subroot"])
    return Manifest(f"{folder}/documents", root, found.select("doc_id", "altered", F.col("digest").alias("leaf"), "subroot", "path"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(text=lowered))
    m = manifest(common.table(spark, sf_dir, "documents"), tampered)
    reached = folded(hexed(F.coalesce("altered", "leaf")), F.col("path"))
    out = m.proofs.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        F.lit(m.root).cast("string").alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        reached.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

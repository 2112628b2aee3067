"""N-gram Jaccard join with token-combination prefixes.

A document is its set of shingles (tokens). All tokens stand in one order: ordinary tokens first, by
hash, then the frequent class, the rarer first. Of n tokens, two sets with Jaccard >= t share one token in
their first n - ceil(t n) + 1, and k tokens in their first n - ceil(t n) + k.

* Ordinary tokens of the first prefix are indexed alone.
* Frequent tokens are indexed as 2-token combinations. The prefix is extended by G tokens, and the frequent
  tokens fall into G classes by hash: of G + 1 shared tokens two are of one class, so it is enough to index
  the combinations within a class. With G in proportion to n, their number is in proportion to n.

If two sets share no ordinary token within both first prefixes, what they share there is frequent; as
frequent tokens come last, so is all that they share in the extended prefixes, and a combination meets.

Candidates are verified on the whole sets. A first round tests each entry of a posting list against the
list's first document only; a second round tests the pairs of a list whose documents are still in
different components. Pairs in one component need no test, and no link between components is missed. Long
lists are tested in blocks, by set sizes and bitmaps within a task; only pairs that pass become rows.

The frequent class is a bounded hint (the MAX_FREQUENT tokens that most documents hold, seen at least
FREQUENT times): whichever tokens are in it, results are the same.

Defined results: null or white text has n_shingles 0 and is its own component; equal sets are linked; rows
that repeat a doc_id are one document with each of their sets; a null doc_id is returned with null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .hashing import digest, mix, signed, windows, words

WIDTH = 5
PERCENT = 80
#: In at least so many documents, as far as the batches show it, a token may be of the frequent class.
FREQUENT = 32
#: At most so many tokens make the frequent class, 1 MB as shared with the executors.
MAX_FREQUENT = 1 << 17
LOCAL = 3
#: Tokens counted together where they are read; a token is passed on if LOCAL of the documents there hold it.
POOL = 1 << 21
#: Length of a set's bitmap at least.
BITS = 1024
#: Lists up to this length give their pairs as rows; longer ones are tested in blocks of BLOCK, GROUP rows to a task.
SHORT = 6
BLOCK = 512
GROUP = 16_384


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' fingerprints, sorted."""
    if not text:
        return np.empty(0, np.uint64)
    h, _, _ = words(text.encode("utf-8", "replace"), lower=True)
    if 0 < len(h) < width:
        return windows(h, len(h), salt=len(h))
    return np.unique(windows(h, width))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of tokens by a hash, as signed words: BITS of them, doubled for larger sets until there are four to a token."""
    bits = max(BITS, 1 << (4 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens + np.uint64(1)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shared(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def levels(n: int, percent: int = PERCENT) -> list[int]:
    """A pair works at the level of its smaller set; sets of this size may be the larger or the smaller."""
    top = n.bit_length() - 1
    return [top, top - 1] if shared(n, percent) < 1 << top else [top]


def keys(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set of tokens. frequent: sorted tokens of that class; rank: their places in the order."""
    n = len(tokens)
    if n < 2:  # such a set is similar to itself only
        return np.empty(0, np.uint64)
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    first = n - shared(n, percent) + 1
    plain = tokens[~often]
    out = [mix(plain[:first])]
    if len(plain) < first:
        late = tokens[often][np.argsort(rank[at[often]])]
        for level in levels(n, percent):
            groups = max(1, (1 << level) // 10)
            some = late[: max(0, first + groups - len(plain))]
            # tokens of one class stand together; then each step pairs with the next one of the class, the one after that, ...
            kind = some % np.uint64(groups)
            order = np.argsort(kind, kind="stable")
            some, kind = some[order], kind[order]
            salt = mix(np.array([level], np.uint64))[0]
            for step in range(1, len(some)):
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                out.append(mix(mix(some[:-step][same]) * np.uint64(3) + mix(some[step:][same]) + salt))
    return np.unique(np.concatenate(out))


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    def counted(pool: list[np.ndarray]) -> pa.RecordBatch:
        all_ = np.sort(np.concatenate([np.empty(0, np.uint64), *pool]))
        edge = np.flatnonzero(np.append(True, all_[1:] != all_[:-1])) if len(all_) else np.empty(0, np.int64)
        n = np.diff(np.append(edge, len(all_)))
        return pa.RecordBatch.from_arrays([pa.array(signed(all_[edge][n >= LOCAL])), pa.array(n[n >= LOCAL], pa.int64())], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, size = [], 0
        for batch in batches:
            for t in batch.column("text"):
                pool.append(shingles(t.as_py(), width))
                size += len(pool[-1])
                if size >= POOL:
                    yield counted(pool)
                    pool, size = [], 0
        yield counted(pool)

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    place = np.empty(len(tokens), np.int64)
    place[np.lexsort((tokens, n))] = np.arange(len(tokens))
    return tokens[order], place[order]


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, two fingerprints and the bitmap of the set, index keys."""
    hint = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def run(doc_id: list, text: list) -> list[list]:
        frequent, rank = hint.value
        sets = [shingles(t, width) for t in text]
        marks = [digest(s) for s in sets]
        index = [signed(keys(s, frequent, rank, percent)) for s in sets]
        return [[len(s) for s in sets], [a for a, _ in marks], [b for _, b in marks], [bitmap(s) for s in sets], index]

    return common.with_columns_by(docs.select("doc_id", "text"), ["doc_id"], {"doc_id": F.col("doc_id"), "text": F.col("text")}, run, "n long, h1 long, h2 long, bits array<long>, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    def run(text: list) -> list[list]:
        return [[shingles(t, width).tobytes() for t in text]]

    some = common.narrowed(docs.select("doc_id", "text"), ids, ["doc_id"])
    return common.with_columns_by(some, ["doc_id"], {"text": F.col("text")}, run, "tokens binary")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar, as a written table."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id"))
    sets = common.written(_sets(docs, ids, width))
    common.released(docs.sparkSession)
    wide = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")

    def run(a: list, b: list) -> list[list]:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            out.append(100 * same >= percent * (len(x) + len(y) - same))
        return [out]

    out = common.with_columns_by(wide, ["u", "v"], {"a": F.col("a"), "b": F.col("b")}, run, "similar boolean")
    out = common.written(out.filter("similar").select("u", "v"))
    common.released(docs.sparkSession)
    return out


def _fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose set sizes and bitmaps let them be similar, as a written table.

    With b(x) the parity of tokens by hash bit, tokens of one set only are at least |b(x) xor b(y)| many, so the
    intersection is at most (|x| + |y| - |b(x) xor b(y)|) / 2 (Sandes et al., 2017). The test loses no link.
    """
    n = sizes.select("doc_id", "n")
    near = pairs.distinct().join(n.toDF("u", "nu"), "u").join(n.toDF("v", "nv"), "v").filter(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    near = common.written(near.select("u", "v").distinct())
    wide = near.join(sizes.toDF("u", "nu", "bu"), "u").join(sizes.toDF("v", "nv", "bv"), "v")
    wide = wide.filter(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    # half a bitmap laid over its other half is the bitmap of half the length
    fold = lambda b: F.zip_with(F.slice(b, F.lit(1), (F.size(b) / 2).cast("int")), F.slice(b, (F.size(b) / 2 + 1).cast("int"), (F.size(b) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    a = F.when(F.size("bu") > F.size("bv"), fold("bu")).otherwise(F.col("bu"))
    b = F.when(F.size("bv") > F.size("bu"), fold("bv")).otherwise(F.col("bv"))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    most = F.floor((F.col("nu") + F.col("nv") - apart) / 2)
    return common.written(wide.filter(100 * most >= percent * (F.col("nu") + F.col("nv") - most)).select("u", "v").distinct())


def _candidates(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents of different components in one block, or of its two blocks, that sizes and bitmaps allow."""
    ids, comp, n = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy(), pdf["n"].to_numpy()
    bits = pdf["bits"].to_numpy()
    level = np.array([len(b) for b in bits])
    side = (pdf["own"] == pdf["p"]).to_numpy()
    values, counts = np.unique(comp, return_counts=True)
    rare = comp != values[counts.argmax()]  # a pair has at least one document outside the commonest component
    lone = pdf["p"].iat[0] == pdf["q"].iat[0]
    us, vs = [ids[:0]], [ids[:0]]
    for mine, theirs in [(rare, np.ones(len(ids), bool))] if lone else [(side & rare, ~side), (side & ~rare, ~side & rare)]:
        for size in np.unique(level[mine]):
            for other in (size // 2, size, 2 * size):
                a, b = np.flatnonzero(mine & (level == size)), np.flatnonzero(theirs & (level == other))
                if not len(a) or not len(b):
                    continue
                x, y = (_folded(np.stack(bits[k]).view(np.uint64), min(size, other)) for k in (a, b))
                step = max(1, (1 << 19) // (len(b) * y.shape[1]))
                for at in range(0, len(a), step):
                    r = a[at : at + step]
                    apart = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                    both = n[r][:, None] + n[b][None, :]
                    most = (both - apart) // 2
                    ok = (100 * most >= percent * (both - most)) & (comp[r][:, None] != comp[b][None, :])
                    i, j = np.nonzero(ok)
                    us.append(ids[r[i]])
                    vs.append(ids[b[j]])
    return np.concatenate(us), np.concatenate(vs)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    return bits if bits.shape[1] == words else bits[:, :words] ^ bits[:, words:]


def _across(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs u > v across components in long lists (key, doc_id, component, size), tested in blocks within the tasks, so only what passes becomes a row."""
    spark = rows.sparkSession
    x = rows.join(sizes, "doc_id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    x = x.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", "blocks", "size")
    x = common.written(x)
    groups = max(1, -(-x.count() // GROUP))
    common.released(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for _, part in pdf.groupby(["key", "p", "q"], sort=False):
            u, v = _candidates(part, percent)
            us.append(np.maximum(u, v))
            vs.append(np.minimum(u, v))
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}).drop_duplicates()

    found = x.withColumn("g", F.pmod(F.xxhash64("key", "p", "q"), F.lit(groups))).groupBy("g").applyInPandas(run, "u long, v long")
    return common.written(found.distinct())


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    marks = common.written(signatures(docs, width, percent))
    common.released(spark)
    full = marks.filter("n > 0 AND doc_id IS NOT NULL")
    sets = common.written(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    equal = full.select("doc_id", "h1", "h2", "n").join(sets, ["h1", "h2", "n"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    equal = common.written(equal.filter("u <> v").distinct())
    # keys are dealt out before copies are taken away: most keys are met once and end here, and the arrays never move
    posts = full.select(F.explode("keys").alias("key"), "doc_id")
    often = common.written(posts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"))
    common.released(spark)
    posts = common.written(posts.join(often, "key"))
    common.released(spark)
    # one document of each set goes on; a doc_id whose rows differ goes on with all its sets
    posts = posts.join(sets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    lists = posts.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("pivot")).filter("size > 1")
    posts = common.written(posts.join(lists.select("key", "pivot"), "key"))
    common.released(spark)
    sizes = full.select("doc_id", "n", "bits")
    star = _fitting(posts.filter("doc_id <> pivot").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")), sizes, percent)
    links = _verified(star, docs, width, percent)
    parts = components(links)
    placed = posts.select("key", "doc_id").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = common.written(placed)
    lists = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
    open_ = common.written(placed.join(lists, "key"))
    common.released(spark)
    short = open_.filter(F.col("size") <= SHORT)
    left, right = short.select("key", F.col("doc_id").alias("u"), F.col("component").alias("cu")), short.select("key", F.col("doc_id").alias("v"), F.col("component").alias("cv"))
    rest = _fitting(left.join(right, "key").filter("u > v AND cu <> cv").select("u", "v"), sizes, percent)
    rest = rest.union(_across(open_.filter(F.col("size") > SHORT), sizes, percent)).distinct()
    tested = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rest = common.written(rest.join(tested, ["u", "v"], "left_anti"))
    common.released(spark)
    more = _verified(rest, docs, width, percent)
    whole = components(links.union(more).union(equal))
    out = marks.select("doc_id", F.col("n").alias("n_shingles")).join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id.

    All rows of an id go as soon as one of them is linked to a smaller id; rows that share the smallest id stay each.
    Null ids aren't told apart, so all their rows stay; so do null and empty texts, which are linked with nothing.
    """
    found = near_duplicates(docs.select("doc_id", "text")).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)

"""Document frequency, rare tokens, set overlap, co-citation pairs and joins by shared rare keys.

`items` is always long: (item, key), one row for each key an item holds. Pairs come from equi-joins on keys
that few items hold, never from all against all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..sources.sinks import partitions, settled
from . import bridges
from .meetings import jaccard_of, linked  # noqa: F401


def document_frequency(items: DataFrame) -> DataFrame:
    return items.distinct().groupBy("key").agg(F.count("*").alias("df"))


def rare(items: DataFrame, low: int = 2, high: int = 200) -> DataFrame:
    """item, key, df of the keys that low..high items hold."""
    return items.distinct().join(document_frequency(items).filter(F.col("df").between(low, high)), "key").select("item", "key", "df")


def sharing(items: DataFrame) -> DataFrame:
    """i < j, shared: pairs of items with a key in common, and how many keys. Tasks are as many as the pairs that keys make need."""
    held = settled(items.select("key", "item"))
    made = held.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    n = partitions(held, int(made or 0))
    held = held.repartition(n, "key")
    left, right = held.select("key", F.col("item").alias("i")), held.select("key", F.col("item").alias("j"))
    return left.join(right.hint("merge"), "key").filter("i < j").repartition(n, "i", "j").groupBy("i", "j").agg(F.count("*").alias("shared"))


def co_cited(lists: DataFrame) -> DataFrame:
    """i < j, n: pairs of members of one list, and in how many lists. lists: (list, item)."""
    return sharing(lists.select(F.col("list").alias("key"), "item").distinct()).withColumnRenamed("shared", "n")


def jaccard(items: DataFrame) -> DataFrame:
    """i, j, overlap, jaccard of the pairs that share a key; any other pair has 0."""
    items = items.distinct()
    size = items.groupBy("item").agg(F.count("*").alias("n"))
    x = sharing(items).join(size.toDF("i", "ni"), "i").join(size.toDF("j", "nj"), "j")
    return x.select("i", "j", F.col("shared").alias("overlap"), (F.col("shared") / (F.col("ni") + F.col("nj") - F.col("shared"))).alias("jaccard"))


def eligible(pairs: DataFrame, rare_items: DataFrame) -> DataFrame:
    """pairs (i, j) that share no rare key."""
    return pairs.join(sharing(rare_items.select("item", "key")).select("i", "j"), ["i", "j"], "left_anti")


def capped_rarest(rare_items: DataFrame, k: int = 64) -> DataFrame:
    """At most the k rarest keys of each item, ties by key."""
    w = Window.partitionBy("item").orderBy("df", "key")
    return rare_items.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def adamic_adar(edges: DataFrame) -> DataFrame:
    """i < j, score: sum over common neighbours of 1 / ln(degree). edges: (item, key)."""
    edges = edges.distinct()
    w = edges.groupBy("key").agg((1.0 / F.log(F.greatest(F.count("*"), F.lit(2)).cast("double"))).alias("w"))
    x = edges.join(w, "key")
    left, right = x.select("key", "w", F.col("item").alias("i")), x.select("key", F.col("item").alias("j"))
    return left.join(right, "key").filter("i < j").groupBy("i", "j").agg(F.sum("w").alias("score"))


def bridge_triples(rare_items: DataFrame, area: DataFrame, cites: DataFrame | None = None, cap: int = 150) -> DataFrame:
    """a < b, c, score: c shares at least two rare keys with both a and b, which share none, in three different areas; the first c of each (a, b) wins.

    a and b are among the `cap` neighbours of c with the largest summed 1/df, ties by larger id. rare_items: (item, key, df).
    """
    held = settled(rare_items.select("item", "key", "df").distinct())
    if cites is None and not bridges.few_keys(held):
        sets, starts, dfs = bridges.key_sets(held)
        return bridges.bridged(sets, bridges.heaviest(sets, starts, dfs, 2, cap), area)
    w = Window.partitionBy("c").orderBy(F.desc("weight"), F.desc("x"))
    n = neighbours(held, 2).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)
    # areas go in before the two sides of a centre meet, so pairs within an area are never made
    n = settled(n.select("c", "x", "weight"))
    n = settled(n.join(area.toDF("c", "area_c"), "c").join(area.toDF("x", "area_x"), "x").filter("area_c <> area_x"))
    left, right = n.select("c", F.col("x").alias("a"), F.col("weight").alias("wa"), F.col("area_x").alias("area_a")), n.select("c", F.col("x").alias("b"), F.col("weight").alias("wb"), F.col("area_x").alias("area_b"))
    x = settled(left.join(right, "c").filter("a < b AND area_a <> area_b").select("a", "b", "c", F.least("wa", "wb").alias("score")))
    # the pairs asked for meet the keys and the citations; those of all items never meet each other
    asked = x.select("a", "b").distinct()
    share = asked.join(held.select(F.col("item").alias("a"), "key"), "a").join(held.select(F.col("item").alias("b"), "key"), ["b", "key"], "left_semi")
    x = x.join(share.select("a", "b").distinct(), ["a", "b"], "left_anti")
    if cites is not None:
        x = settled(x)
        ends = (("a", "b"), ("a", "c"), ("b", "c"))
        asked = reduce(DataFrame.union, (x.select(p, q).toDF("p", "q") for p, q in ends)).distinct()
        both = cites.select(F.col("item").alias("p"), F.col("cited").alias("q"))
        both = settled(both.union(both.select("q", "p")).join(asked, ["p", "q"], "left_semi").distinct())
        for p, q in ends:
            x = x.join(both.toDF(p, q), [p, q], "left_anti")
    first = x.groupBy("a", "b").agg(F.min(F.struct("c", "score")).alias("f"))
    return first.select("a", "b", "f.c", "f.score")


def neighbours(held: DataFrame, least: int) -> DataFrame:
    """c, x, weight: items that share at least `least` keys with c, and the summed 1/df of these. held: (item, key, df), each once."""
    if least > 1 and bridges.few_keys(held):
        return bridges.by_key_pairs(held, least).select("c", "x", "weight")
    left, right = held.select("key", "df", F.col("item").alias("c")), held.select("key", F.col("item").alias("x"))
    n = left.join(right, "key").filter("c <> x").groupBy("c", "x").agg(F.count("*").alias("shared"), rounded(F.sum(1.0 / F.col("df")), 9).alias("weight"))
    return n.filter(F.col("shared") >= least).select("c", "x", "weight")


def file_uses(edges: DataFrame, files: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """file, used: the files whose items cite items of another file, of `used` (used) if given. edges: (item, cited); files: (item, file)."""
    to = files.select(F.col("item").alias("cited"), F.col("file").alias("used"))
    x = edges.join(to if used is None else settled(to.join(used, "used", "left_semi").select("cited", "used")), "cited").select("item", "used")
    x = (x if used is None else settled(x)).join(files, "item")
    return x.filter("file <> used").select("file", "used").distinct()


def _used_by_one(pairs: DataFrame, a: str, b: str, edges: DataFrame) -> DataFrame:
    """The distinct (a, b) of pairs that one left end of edges (by, to) leads to both."""
    e = edges.toDF("by", "to")
    return pairs.select(a, b).distinct().join(e.withColumnRenamed("to", a), a).join(e.withColumnRenamed("to", b), ["by", b], "left_semi").select(a, b).distinct()


def link_reasons(pairs: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """pairs (a, b) with the first reason to hold them linked: cited by one item, in one file, their files used by one file, their files using each other; else kept.

    edges: (item, cited); files: (item, file), an item without a file being in none.
    """
    pairs, edges, files = settled(pairs), settled(edges.select("item", "cited")), files.select("item", "file")
    # only the files of the ends, and what uses them, are asked for: where pairs are few, these are
    ends = pairs.select("a").union(pairs.select("b")).toDF("item").distinct()
    of = settled(files.join(ends, "item", "left_semi"))
    x = settled(pairs.join(of.toDF("a", "file_a"), "a", "left").join(of.toDF("b", "file_b"), "b", "left"))
    uses = settled(file_uses(edges, files, x.select("file_a").union(x.select("file_b")).toDF("used").distinct()))
    both = uses.union(uses.select("used", "file")).toDF("file_a", "file_b").distinct()
    x = x.join(_used_by_one(x, "a", "b", edges).withColumn("__cited", F.lit(True)), ["a", "b"], "left")
    x = x.join(_used_by_one(x, "file_a", "file_b", uses).withColumn("__used", F.lit(True)), ["file_a", "file_b"], "left")
    x = x.join(both.withColumn("__each", F.lit(True)), ["file_a", "file_b"], "left")
    reason = F.when(F.col("__cited"), "co-cited").when(F.col("file_a") == F.col("file_b"), "same file").when(F.col("__used"), "one file uses both").when(F.col("__each"), "files use each other")
    return x.select(*pairs.columns, reason.alias("reason")).fillna("kept", ["reason"])


def as_of(points: DataFrame, headers: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """points with the `value` of the last header of the same `by` at or before them (a union and one window, no range join)."""
    cols = [c for c in points.columns if c != value]
    p = points.select(by, at, F.lit(1).alias("__kind"), F.struct(*cols).alias("__row"), F.lit(None).cast(headers.schema[value].dataType).alias(value))
    h = headers.select(by, at, F.lit(0).alias("__kind"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), value)
    w = Window.partitionBy(by).orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(h).withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__kind = 1").select("__row.*", value)


def outermost(spans: DataFrame, by: str, start: str, end: str, key: str) -> DataFrame:
    """Spans that no other span of the same `by` contains (equal spans: the smaller key stays): one window over starts."""
    w = Window.partitionBy(by).orderBy(F.col(start), F.desc(end), key).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__reach", F.max(end).over(w)).filter(F.col("__reach").isNull() | (F.col("__reach") < F.col(end))).drop("__reach")


def far_pairs(items: DataFrame, area: DataFrame, high: int = 200, limit: float = 0.05, per_key: int = 20) -> DataFrame:
    """i < j, key: pairs of different areas that share a rare key (of 2 to `high` items) though their Jaccard is below limit; the rarest key of a pair, at most per_key pairs of a key in seeded order."""
    x, codes = linked(items, 2, high, area, limit, ("code",))
    # numbers travel, and hashes are made where they are compared
    w = Window.partitionBy("code").orderBy(F.unhex(F.sha2(F.concat_ws(":", F.lit("far"), "i", "j"), 256)))
    x = x.repartition("code").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_key)
    return x.join(codes.select("code", "key"), "code").select("i", "j", "key")

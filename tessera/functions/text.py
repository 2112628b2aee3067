"""Text expressions: identifiers, words, normalisation, TF-IDF, signed hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_.']*"
WORD = r"[\p{L}\p{N}_]{2,}"


def tokens(docs: DataFrame, id_: str, text: str, pattern: str = IDENTIFIER) -> DataFrame:
    """item, key: distinct matches of the pattern in each text."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    return docs.select(F.col(id_).alias("item"), F.explode(found).alias("key"))


def counts(docs: DataFrame, id_: str, text: str, pattern: str = WORD) -> DataFrame:
    """item, key, tf of lower-cased matches."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return docs.select(F.col(id_).alias("item"), F.explode(found).alias("key")).groupBy("item", "key").agg(F.count("*").alias("tf"))


def tfidf(tf: DataFrame, n_items: DataFrame, min_df: int = 5, max_share: float = 0.5) -> DataFrame:
    """item, key, w: sublinear tf times smoothed idf, unit length per item. n_items: one row with n."""
    df = tf.groupBy("key").agg(F.count("*").alias("df"))
    x = tf.join(df, "key").crossJoin(F.broadcast(n_items)).filter((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n")))
    w = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    x = x.select("item", "key", w.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item")))
    return x.withColumn("w", F.col("w") / norm)


def hashed_ngrams(docs: DataFrame, id_: str, text: str, buckets: int = 256) -> DataFrame:
    """item, bucket, value: signed hashed counts of 1- to 3-grams of words, unit length."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    x = docs.select(F.col(id_).alias("item"), words.alias("w"))
    at = F.sequence(F.lit(0), F.size("w") - 1)

    def of(n: int) -> tuple[Column, Column]:
        return F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " ")), F.transform(at, lambda i: i + n <= F.size("w"))

    sizes = [of(n) for n in (1, 2, 3)]
    grams, enough = (F.flatten(F.array(*x)) for x in zip(*sizes, strict=True))
    x = x.filter(F.size("w") > 0).select("item", F.explode(F.arrays_zip(grams.alias("g"), enough.alias("ok"))).alias("x")).filter("x.ok").select("item", F.col("x.g").alias("gram"))
    h = F.sha2("gram", 256)
    b = (F.conv(F.substring(h, 1, 6), 16, 10).cast("long") % buckets).alias("bucket")
    s = F.when(F.conv(F.substring(h, 7, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    x = x.select("item", b, s.alias("s")).groupBy("item", "bucket").agg(F.sum("s").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("item")).cast("double"))
    return x.filter("v <> 0").select("item", "bucket", (F.col("v") / norm).alias("value"))


def squeezed(c: str | Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def second_part(c: str | Column, otherwise: str | Column = "") -> Column:
    """Second dot-component of a name; without a dot, `otherwise` (a literal or a column)."""
    col = F.col(c) if isinstance(c, str) else c
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return F.when(col.contains("."), F.split_part(col, F.lit("."), F.lit(2))).otherwise(other)


def id_year(c: str) -> Column:
    """Year of a paper id: yymm.nnnnn, or archive/yymmnnn with two-digit years from 1991."""
    yy = F.when(F.col(c).contains("/"), F.regexp_extract(c, r"/(\d\d)", 1)).otherwise(F.regexp_extract(c, r"^(\d\d)", 1)).cast("int")
    return F.when(yy > 90, 1900 + yy).otherwise(2000 + yy)

"""Table catalogue: schemas by name, loaders, and the citation-shaped views the study queries run on.

Roles of the bundled star schema: an order is a paper (its year, and the nation of its customer as area), a
part is a work, a line is a citation, a supplier an author whose nation is a secondary area of the paper, a
region the parent of areas. A work's own area is its size modulo the number of areas. Paper p cites paper
p - l_linenumber.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import partitions

AREAS = 25


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or gzip JSON lines under a declared schema; gzip can't be split, so rows are dealt out again."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def single_column(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A one-column list: no header, tabs, no quotes."""
    return spark.read.csv(path, schema=f"{name} string", sep="\t", quote="")


def labelled_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def tagged(rows: DataFrame, prefix: str, schema: str, column: str = "value") -> DataFrame:
    """Log lines that begin with a tag, and the JSON after it."""
    cut = F.expr(f"substring({column}, {len(prefix) + 1})")
    return rows.filter(F.col(column).startswith(prefix)).select(F.from_json(cut, schema).alias("r")).select("r.*")


def hits(rows: DataFrame, column: str = "value") -> DataFrame:
    """rev:file:line:text, split at the first three colons."""
    parts = F.split(column, ":", 4)
    names = ("rev", "file", "line", "text")
    return rows.select(*(parts[k].alias(n) for k, n in enumerate(names))).withColumn("line", F.col("line").cast("long"))


def papers(spark: SparkSession, d: str) -> DataFrame:
    """paper, year, area."""
    o = load(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    c = load(spark, d, "customer", ["c_custkey", "c_nationkey"])
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("paper"), F.year("o_orderdate").cast("long").alias("year"), F.col("c_nationkey").cast("long").alias("area")
    )


def _by_paper(spark: SparkSession, d: str, column: str) -> tuple[DataFrame, int]:
    """The distinct (l_orderkey, column) of the lines, dealt by paper to as many tasks as the lines need; and how many these are."""
    lines_ = load(spark, d, "lineitem", ["l_orderkey", column])
    n = partitions(lines_, lines_.count())
    return lines_.repartition(n, "l_orderkey").distinct(), n


def citations(spark: SparkSession, d: str) -> DataFrame:
    """paper, work, area, year: each work a paper cites, once."""
    li, n = _by_paper(spark, d, "l_partkey")
    return papers(spark, d).repartition(n, "paper").join(li, F.col("paper") == F.col("l_orderkey")).select("paper", F.col("l_partkey").alias("work"), "area", "year")


def authors(spark: SparkSession, d: str) -> DataFrame:
    """paper, author."""
    return _by_paper(spark, d, "l_suppkey")[0].toDF("paper", "author")


def secondary(spark: SparkSession, d: str) -> DataFrame:
    """paper, area2: areas of a paper's authors other than its own."""
    s = load(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    a = authors(spark, d).join(s, F.col("author") == F.col("s_suppkey")).select("paper", F.col("s_nationkey").cast("long").alias("area2"))
    return a.join(papers(spark, d), "paper").filter("area2 <> area").select("paper", "area2").distinct()


def references(spark: SparkSession, d: str) -> DataFrame:
    """paper, cited: papers that papers cite."""
    li = load(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    refs = li.select(F.col("l_orderkey").alias("paper"), (F.col("l_orderkey") - F.col("l_linenumber")).alias("cited")).distinct()
    return refs.join(papers(spark, d).select(F.col("paper").alias("cited")), "cited", "left_semi").select("paper", "cited")


def work_areas(spark: SparkSession, d: str) -> DataFrame:
    """work, home: a work's own area."""
    return load(spark, d, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("work"), (F.col("p_size").cast("long") % AREAS).alias("home"))


def areas(spark: SparkSession, d: str) -> DataFrame:
    """area, parent."""
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("area"), F.col("n_regionkey").cast("long").alias("parent"))


#: The same views for the oracle, as common table expressions.
SQL = {
    "paper": "paper as (select o_orderkey paper, year(o_orderdate)::bigint as year, c_nationkey::bigint area from orders join customer on o_custkey = c_custkey)",
    "cit": "cit as (select p.paper, l.l_partkey as work, p.area, p.year from paper p join (select distinct l_orderkey, l_partkey from lineitem) l on p.paper = l.l_orderkey)",
    "author": "author as (select distinct l_orderkey paper, l_suppkey author from lineitem)",
    "sec": "sec as (select distinct a.paper, s.s_nationkey::bigint area2 from author a join supplier s on a.author = s.s_suppkey join paper p on p.paper = a.paper where s.s_nationkey <> p.area)",
    "ref": "ref as (select distinct l_orderkey paper, l_orderkey - l_linenumber cited from lineitem where l_orderkey - l_linenumber in (select paper from paper))",
    "home": "home as (select p_partkey as work, (p_size % 25)::bigint home from part)",
    "areas": "areas as (select n_nationkey::bigint area, n_regionkey::bigint parent from nation)",
}


def with_sql(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)

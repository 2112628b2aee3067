"""Queries that write tables in the formats of the sources, and read them back through the readers, each with its SQL."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import encode, rank
from ..sources import records, sinks
from ..sources import tables as t
from ..sources.tables import with_sql
from .registry import query


@query("jsonl_round_trip", with_sql("paper", "cit") + " select work, count(*) citers, min(year) as first from cit group by work")
def jsonl_round_trip(spark, d):
    """Papers with their lists of works as gzip JSON lines, the absent lists as empty ones."""
    lists = t.citations(spark, d).groupBy("paper", "year").agg(F.sort_array(F.collect_list("work")).alias("works"))
    path = sinks.scratch(spark)
    sinks.write_jsonl(lists.withColumn("works", F.when(F.size("works") > 0, F.col("works"))), path)
    back = t.jsonl(spark, path, "paper long, year long, works array<long>")
    x = back.select("year", F.explode(F.coalesce("works", F.array().cast("array<long>"))).alias("work"))
    return x.groupBy("work").agg(F.count("*").alias("citers"), F.min("year").alias("first"))


@query("tagged_log", "select user_id, count(*) events, max(event_id) as latest from events where event_type <> (select min(event_type) from events) group by user_id")
def tagged_log(spark, d):
    """A log in which some lines carry a tag and JSON."""
    e = t.load(spark, d, "events", ["event_id", "user_id", "event_type"])
    x = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("first"))))
    row = F.to_json(F.struct("event_id", "user_id"))
    path = sinks.scratch(spark)
    x.select(F.when(F.col("event_type") == F.col("first"), F.concat(F.lit("note: "), row)).otherwise(F.concat(F.lit("EVENT "), row)).alias("value")).write.text(path)
    back = t.tagged(spark.read.text(path), "EVENT ", "event_id long, user_id long")
    return back.groupBy("user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("latest"))


@query("search_hits", "select source as file, doc_id as line, lang || ': ' || coalesce(n_chars::varchar, '') as text from documents")
def search_hits(spark, d):
    """Hits of a search as rev:file:line:text, where the text holds colons too."""
    docs = t.load(spark, d, "documents", ["doc_id", "source", "lang", "n_chars"])
    path = sinks.scratch(spark)
    docs.select(F.concat_ws(":", F.lit("r1"), "source", F.col("doc_id").cast("string"), F.concat("lang", F.lit(": "), F.coalesce(F.col("n_chars").cast("string"), F.lit("")))).alias("value")).write.text(path)
    return t.hits(spark.read.text(path)).select("file", "line", "text")


@query("csv_round_trip", "select quality, toxic, count(*) n, sum(doc_id)::bigint ids from labels group by 1, 2")
def csv_round_trip(spark, d):
    path = sinks.scratch(spark)
    t.load(spark, d, "labels").select("doc_id", "quality", "toxic").write.option("header", True).csv(path)
    back = t.labelled_csv(spark, path, "doc_id long, quality int, toxic int")
    return back.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("wanted_names", "select c_custkey as key from customer where c_mktsegment = 'BUILDING'")
def wanted_names(spark, d):
    """A one-column list of names, and the rows that it wants."""
    c = t.load(spark, d, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    path = sinks.scratch(spark)
    c.filter("c_mktsegment = 'BUILDING'").select("c_name").write.csv(path, sep="\t", quote="")
    return c.join(t.single_column(spark, path, "c_name"), "c_name", "left_semi").select(F.col("c_custkey").alias("key"))


@query("written_lines", r"with x as (select trim(unnest(string_split(text, chr(10)))) l from documents) select count(*) n, sum(length(l))::bigint chars, max(length(l))::bigint longest from x where l <> ''")
def written_lines(spark, d):
    path = sinks.scratch(spark)
    t.load(spark, d, "documents", ["text"]).filter("text IS NOT NULL").select("text").write.text(path)
    x = t.lines(spark, path)
    return x.agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.max(F.length("line")).cast("long").alias("longest"))


@query("xml_round_trip", "select p_partkey as id, p_size::bigint size, p_brand as brand from part")
def xml_round_trip(spark, d):
    p = t.load(spark, d, "part", ["p_partkey", "p_size", "p_brand"])
    rows = p.select(F.to_xml(F.struct(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"), F.col("p_brand").alias("brand"))).alias("value"))
    return records.xml_records(sinks.settled(rows), "value", "id long, size long, brand string")


@query("concatenated_states", "select conv_id, count(*) turns, max(turn) as latest, sum(length(text))::bigint chars from conversations where text is not null group by conv_id")
def concatenated_states(spark, d):
    """A conversation's turns as JSON objects one after another in one text."""
    c = t.load(spark, d, "conversations").filter("text IS NOT NULL")
    one = c.groupBy("conv_id").agg(F.concat_ws("\n ", F.collect_list(F.to_json(F.struct("conv_id", "turn", "text")))).alias("body"))
    back = records.concatenated_json(sinks.settled(one), "body", "conv_id long, turn long, text string")
    return back.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("latest"), F.sum(F.length("text")).alias("chars"))


@query("aligned_files", "select lang, count(*) n, sum(n_chars)::bigint chars from documents group by lang")
def aligned_files(spark, d):
    """Two files written beside each other, joined where each key stands once on both sides."""
    docs = t.load(spark, d, "documents", ["doc_id", "lang", "n_chars"])
    x = records.aligned(sinks.settled(docs.select("doc_id", "lang")), sinks.settled(docs.select("doc_id", "n_chars")), "doc_id")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


@query("span_bodies", "select doc_id as name, array_to_string(string_split(text, chr(10))[2:3], chr(10)) body from documents where text is not null")
def span_bodies(spark, d):
    docs = t.load(spark, d, "documents", ["doc_id", "text"]).filter("text IS NOT NULL").withColumnRenamed("doc_id", "file")
    return records.line_spans(docs.select("file", F.col("file").alias("name"), F.lit(2).alias("first"), F.lit(3).alias("last")), docs)


@query("snapshot_authors", "with x as (select l_orderkey k, list(distinct l_suppkey) a, bool_or(l_returnflag = 'R') r from lineitem group by 1) select k as paper, len(a)::bigint authors, list_min(a) as first from x where r")
def snapshot_authors(spark, d):
    """Authors of wanted papers out of nested rows of a snapshot, identifiers in any case."""
    works = t.load(spark, d, "lineitem", ["l_orderkey", "l_suppkey", "l_returnflag"]).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    nested = works.select(F.concat(F.lit("10.1/P"), F.col("l_orderkey").cast("string")).alias("doi"), F.transform("s", lambda s: F.struct(F.struct(s.alias("id")).alias("author"), F.lit("other").alias("position"))).alias("authorships"), F.lit("x" * 50).alias("unread"))
    want = works.filter("r").select(F.concat(F.lit("10.1/p"), F.col("l_orderkey").cast("string")).alias("doi"))
    x = records.enriched(sinks.settled(nested), want, records.AUTHORS)
    return x.select(F.substring_index("doi", "p", -1).cast("long").alias("paper"), F.size("authors").cast("long").alias("authors"), F.array_min("authors").alias("first"))


@query("preferred_rows", "select l_partkey as work, l_orderkey as paper, l_linenumber as line from lineitem qualify row_number() over (partition by l_partkey order by l_returnflag <> 'R', l_orderkey, l_linenumber) = 1")
def preferred_rows(spark, d):
    li = t.load(spark, d, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber", "l_returnflag"]).withColumn("returned", F.col("l_returnflag") == "R")
    x = records.preferred(li.select("l_partkey", "l_orderkey", "l_linenumber", "returned"), "l_partkey", "returned", "l_orderkey", "l_linenumber")
    return x.select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line"))


@query("resumed_job", "select lang, count(*) n, sum(doc_id)::bigint ids from documents group by lang")
def resumed_job(spark, d):
    """A job that stops after some keys, and goes on with those that are missing."""
    docs, path = t.load(spark, d, "documents", ["doc_id", "lang"]), sinks.scratch(spark)
    sinks.resume(spark, docs, path, "doc_id", lambda x: x.filter("lang = 'en'"))
    return sinks.resume(spark, docs, path, "doc_id", lambda x: x).groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("seal_breaks", "select 'labels' as name, (select count(*) from labels) as rows_, max(doc_id) is not null as broken from labels where toxic = 1 union all select 'nation', count(*), false from nation union all select 'supplier', count(*), false from supplier")
def seal_breaks(spark, d):
    """Seals of tables before and after they are written once; the labels lose what is toxic on the way."""
    names = ("labels", "nation", "supplier")
    before = {n: t.load(spark, d, n) for n in names}
    after = {}
    for n, df in before.items():
        path = sinks.scratch(spark)
        sinks.write_once(df.filter("toxic = 0") if n == "labels" else df.orderBy(F.desc(df.columns[0])), path)
        after[n] = spark.read.parquet(path)
    seals = sinks.seals(before)
    broken = sinks.broken(seals, sinks.seals(after)).select("name", F.lit(True).alias("broken"))
    return seals.join(broken, "name", "left").select("name", F.col("rows").alias("rows_"), F.coalesce("broken", F.lit(False)).alias("broken"))


@query("cell_differences", "select s_suppkey as key, 's_acctbal' as cell from supplier where s_nationkey < 5 union all select s_suppkey, unnest(['s_acctbal', 's_nationkey']) from supplier where s_nationkey = 7")
def cell_differences(spark, d):
    """Against a copy in which some balances differ by more than the tolerance, and some rows are gone."""
    s = t.load(spark, d, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    off = F.when(F.col("s_nationkey") < 5, 0.5).when(F.col("s_nationkey") == 9, 1e-12).otherwise(0.0)
    other = s.filter("s_nationkey <> 7").withColumn("s_acctbal", F.col("s_acctbal").cast("double") + off)
    x = sinks.differences(s.withColumn("s_acctbal", F.col("s_acctbal").cast("double")), other, ["s_suppkey"], 1e-6)
    return x.select(F.col("s_suppkey").alias("key"), F.col("column").alias("cell"))


@query("cumulative_lengths", "with h as (select n_chars // 100 as bin, count(*) n from documents where n_chars is not null group by 1) select bin, n, coalesce(sum(n) over (order by bin rows between unbounded preceding and 1 preceding), 0)::bigint below from h")
def cumulative_lengths(spark, d):
    h = t.load(spark, d, "documents", ["n_chars"]).filter("n_chars IS NOT NULL").groupBy(F.expr("n_chars div 100").alias("bin")).agg(F.count("*").alias("n"))
    return rank.cumulative(h, "bin", ["n"]).select("bin", "n", F.col("n_below").cast("long").alias("below"))


CLASSES = 5


def _byte_shares(windows: list[list[int]]) -> np.ndarray:
    """A stand-in for a model: a window's shares of byte classes."""
    return np.stack([np.bincount(np.array(w) % CLASSES, minlength=CLASSES) / len(w) for w in windows])


@query("pooled_vectors", f"""with b as (select doc_id, h, unnest(range(len(h) // 2)) i from (select doc_id, hex(encode(text)) h from documents where text <> '')), c as (select doc_id, ('0x' || substr(h, 2 * i + 1, 2))::int % {CLASSES} c, count(*)::double n from b group by 1, 2), l as (select doc_id, sqrt(sum(n * n)) l from c group by 1)
select doc_id, {", ".join(f"coalesce(round(max(n / l) filter (where c = {k}), 6), 0) v{k}" for k in range(CLASSES))} from c join l using (doc_id) group by doc_id""")
def pooled_vectors(spark, d):
    """Documents cut into windows of 254 byte tokens, encoded in shared batches and pooled."""
    docs = t.load(spark, d, "documents", ["doc_id", "text"]).filter("text <> ''")
    x = encode.pooled(docs, "doc_id", "text", lambda s: list(s.encode()), _byte_shares)
    return x.select("doc_id", *(rounded(F.element_at("v", k + 1), 6).alias(f"v{k}") for k in range(CLASSES)))


@query("encoded_texts", "select doc_id, length(text)::double chars, len(string_split(text, chr(10)))::double as lines from documents where text is not null")
def encoded_texts(spark, d):
    """Distinct texts encoded once, by a stand-in that counts characters and lines."""
    docs = t.load(spark, d, "documents", ["doc_id", "text"])
    x = encode.encoded(docs, "doc_id", "text", lambda texts: np.array([[len(s), s.count("\n") + 1] for s in texts], float))
    return x.select("doc_id", F.element_at("v", 1).alias("chars"), F.element_at("v", 2).alias("lines"))


@query("halved_requests", "select doc_id from labels where quality is not null and not (quality = 0 and toxic = 1)")
def halved_requests(spark, d):
    """Batches asked of a service that refuses any batch with a bad item: halves isolate it."""
    rows = t.load(spark, d, "labels").filter("quality IS NOT NULL").select("doc_id", ((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("bad"))

    def ask(batch: list) -> list:
        if any(b for _, b in batch):
            raise ValueError("refused")
        return [k for k, _ in batch]

    def run(parts):
        for pdf in parts:
            batch = list(zip(pdf["doc_id"].tolist(), pdf["bad"].tolist(), strict=True))
            found = [k for at in range(0, len(batch), 50) for k in records.halving(batch[at : at + 50], ask)]
            yield pdf[pdf["doc_id"].isin(found)][["doc_id"]]

    return rows.mapInPandas(run, "doc_id long")

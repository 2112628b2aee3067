"""Text, pair and label queries on documents and on the citation-shaped tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import rounded
from ..operators import pairs
from ..operators.certify import duplicates
from ..sources import tables as t
from ..sources.sinks import settled
from ..sources.tables import with_sql
from .registry import query

TOK = "tok as (select distinct doc_id item, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.'']*')) as key from documents)"
DF = "df as (select key, count(*) df from tok group by key)"
RARE = "rare as (select item, tok.key, df.df from tok join df on df.key = tok.key where df.df between 2 and 200)"
#: The pair queries use the keys that `rare` keeps, those of 2 to 200 documents.
LOW = 200
LOWRARE = f"low as (select item, tok.key, df.df from tok join df on df.key = tok.key where df.df between 2 and {LOW})"


def tok(spark, d):
    return tx.tokens(t.load(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


def low(spark, d):
    return pairs.rare(tok(spark, d), 2, LOW)


def area(spark, d):
    return t.load(spark, d, "documents", ["doc_id", "source"]).select(F.col("doc_id").alias("item"), F.col("source").alias("area"))


AREA = "area as (select doc_id item, source area from documents)"


@query("doc_frequency", f"with {TOK}, {DF} select key, df from df")
def doc_frequency(spark, d):
    return pairs.document_frequency(tok(spark, d))


@query("rare_landmarks", f"with {TOK}, {DF}, {RARE} select item, count(*) n, min(df) rarest from rare group by item")
def rare_landmarks(spark, d):
    return pairs.rare(tok(spark, d)).groupBy("item").agg(F.count("*").alias("n"), F.min("df").alias("rarest"))


def _sharing(spark, d):
    """i < j, shared of the documents that share a rare key."""
    return pairs.linked(tok(spark, d), 2, LOW, columns=("shared",))[0]


@query("shared_rare_pairs", f"with {TOK}, {DF}, {LOWRARE} select a.item i, b.item j, count(*) shared from low a join low b on a.key = b.key and a.item < b.item group by 1, 2")
def shared_rare_pairs(spark, d):
    return _sharing(spark, d)


@query("eligible_pairs", f"""with {TOK}, {DF}, {LOWRARE}, sh as (select distinct a.item i, b.item j from low a join low b on a.key = b.key and a.item < b.item), n as (select count(*) n from documents)
select n * (n - 1) // 2 - (select count(*) from sh) eligible, n * (n - 1) // 2 pairs from n""")
def eligible_pairs(spark, d):
    """Of all pairs of documents, those that share no rare key: all less those that do."""
    n = t.load(spark, d, "documents", ["doc_id"]).agg(F.count("*").alias("n"))
    linked = _sharing(spark, d).agg(F.count("*").alias("linked"))
    every = F.expr("n * (n - 1) div 2")
    return n.crossJoin(linked).select((every - F.col("linked")).alias("eligible"), every.alias("pairs"))


VOCAB = """sz as (select item, count(*) n from tok group by item), ov as (select a.item i, b.item j from low a join low b on a.key = b.key and a.item < b.item group by 1, 2),
jac as (select o.i, o.j, count(*) overlap from ov o join tok a on a.item = o.i join tok b on b.item = o.j and b.key = a.key group by 1, 2),
voc as (select i, j, overlap, overlap::double / (a.n + b.n - overlap) jaccard from jac join sz a on a.item = i join sz b on b.item = j)"""


def _vocab(spark, d):
    """Jaccard of whole vocabularies for the pairs that share a rare key."""
    return pairs.linked(tok(spark, d), 2, LOW, columns=("overlap", "jaccard"))[0]


@query("vocab_jaccard", f"with {TOK}, {DF}, {LOWRARE}, {VOCAB} select i, j, overlap, round(jaccard, 6) jaccard from voc")
def vocab_jaccard(spark, d):
    return _vocab(spark, d).withColumn("jaccard", rounded("jaccard", 6))


@query("pair_subsets", f"""with {TOK}, {DF}, {LOWRARE}, {VOCAB}, {AREA} select count(*) all_pairs, count(*) filter (where a.area <> b.area) cross_area, count(*) filter (where jaccard < 0.2::double) low_vocab, count(*) filter (where a.area <> b.area and jaccard < 0.2::double) hard
from voc join area a on a.item = i join area b on b.item = j""")
def pair_subsets(spark, d):
    a = settled(area(spark, d))
    if duplicates(a, "item").isEmpty():
        x = pairs.linked(tok(spark, d), 2, LOW, a, columns=("jaccard", "cross"))[0]
        cross = F.col("cross") == 1
    else:  # a document with several areas counts once for each
        x = _vocab(spark, d).join(a.toDF("i", "ai"), "i").join(a.toDF("j", "aj"), "j")
        cross = F.col("ai") != F.col("aj")
    few = F.col("jaccard") < F.lit(0.2)
    return x.agg(F.count("*").alias("all_pairs"), F.count_if(cross).alias("cross_area"), F.count_if(few).alias("low_vocab"), F.count_if(cross & few).alias("hard"))


@query("overlap_buckets", f"with {TOK}, {DF}, {LOWRARE}, {VOCAB} select least(floor(round(jaccard, 9) * 10), 9)::bigint bucket, count(*) n from voc group by 1")
def overlap_buckets(spark, d):
    b = F.least(F.floor(rounded("jaccard", 9) * 10), F.lit(9)).cast("long")
    return _vocab(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("specialisation", f"with {TOK}, {DF}, n as (select count(*) n from documents), r as (select item, ln(n.n / df.df) v, row_number() over (partition by item order by ln(n.n / df.df) desc) k from tok join df on df.key = tok.key cross join n) select item, round(avg(v), 6) s from r where k <= 3 group by item")
def specialisation(spark, d):
    docs = t.load(spark, d, "documents", ["doc_id"])
    x = tok(spark, d).join(pairs.document_frequency(tok(spark, d)), "key").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    x = x.groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.log(F.col("n") / F.col("df"))), asc=False), 1, 3).alias("v"))
    return x.select("item", rounded(F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v"), 6).alias("s"))


TF = r"""tf as (select item, key, count(*) tf from (select doc_id item, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as key from documents) group by 1, 2),
tdf as (select key, count(*) df from tf group by key), nd as (select count(*) n from documents),
w0 as (select item, tf.key, (1 + ln(tf)) * (ln((1 + n)::double / (1 + df)) + 1) w from tf join tdf on tdf.key = tf.key cross join nd where df >= 5 and df <= 0.5::double * n),
w as (select item, key, w / sqrt(sum(w * w) over (partition by item)) w from w0)"""


def _tfidf(spark, d):
    docs = t.load(spark, d, "documents", ["doc_id", "text"])
    return tx.tfidf(tx.counts(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")))


@query("tfidf_weights", f"with {TF} select item, count(*) terms, round(sum(w), 5) total, round(max(w), 6) top from w group by item")
def tfidf_weights(spark, d):
    return _tfidf(spark, d).groupBy("item").agg(F.count("*").alias("terms"), rounded(F.sum("w"), 5).alias("total"), rounded(F.max("w"), 6).alias("top"))


@query("tfidf_area_profile", f"""with {TF}, p as (select lang, key, avg_w v from (select lang, key, sum(w) avg_w from w join documents on doc_id = item group by 1, 2)), n as (select lang, sqrt(sum(v * v)) n from p group by lang)
select a.lang a, b.lang b, round(sum(a.v * b.v) / (any_value(x.n) * any_value(y.n)), 6) cos from p a join p b on a.key = b.key join n x on x.lang = a.lang join n y on y.lang = b.lang where a.lang < b.lang group by 1, 2""")
def tfidf_area_profile(spark, d):
    docs = t.load(spark, d, "documents", ["doc_id", "lang"]).toDF("item", "lang")
    p = _tfidf(spark, d).join(docs, "item").groupBy("lang", "key").agg(F.sum("w").alias("v"))
    n = p.groupBy("lang").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    x = p.toDF("a", "key", "va").join(p.toDF("b", "key", "vb"), "key").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    x = x.join(F.broadcast(n.toDF("a", "na")), "a").join(F.broadcast(n.toDF("b", "nb")), "b")
    return x.select("a", "b", rounded(F.col("s") / (F.col("na") * F.col("nb")), 6).alias("cos"))


@query("hashed_ngrams", r"""with w as (select item_id item, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') w from benchmark),
g as (select item, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) g from w where len(w) > 0),
h as (select item, sha256(g) h from g), v as (select item, (('0x' || substr(h, 1, 6))::bigint % 256)::bigint bucket, sum(case when ('0x' || substr(h, 7, 1))::int % 2 = 0 then 1 else -1 end)::bigint v from h group by 1, 2)
select item, bucket, round(v / sqrt(sum(v * v) over (partition by item)), 6) as value from v where v <> 0""")
def hashed_ngrams(spark, d):
    return tx.hashed_ngrams(t.load(spark, d, "benchmark"), "item_id", "text").withColumn("value", rounded("value", 6))


@query("ubiquitous_text_drop", """with x as (select conv_id, text, count(*) n from conversations group by 1, 2), df as (select text, count(*) df from x group by text), n as (select count(distinct conv_id) n from conversations),
k as (select x.*, df.df * 2 >= n.n wide from x join df using (text) cross join n), f as (select *, bool_and(wide) over (partition by conv_id) only_wide from k)
select conv_id, sum(n)::bigint size, count(*) texts from f where not wide or only_wide group by conv_id""")
def ubiquitous_text_drop(spark, d):
    from pyspark.sql import Window

    x = t.load(spark, d, "conversations").groupBy("conv_id", "text").agg(F.count("*").alias("n"))
    df = x.groupBy(F.col("text").alias("t")).agg(F.count("*").alias("df"))
    n = x.agg(F.countDistinct("conv_id").alias("all"))
    k = x.join(df, F.col("text").eqNullSafe(F.col("t"))).drop("t").crossJoin(F.broadcast(n)).withColumn("wide", F.col("df") * 2 >= F.col("all"))
    k = k.withColumn("only", F.min("wide").over(Window.partitionBy("conv_id")))
    return k.filter("NOT wide OR only").groupBy("conv_id").agg(F.sum("n").alias("size"), F.count("*").alias("texts"))


@query("lexical_controls", r"""with q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) w from benchmark), o as (select a.item_id q, b.item_id c, count(*) ov from q a join q b on a.w = b.w and a.item_id <> b.item_id group by 1, 2),
n as (select item_id, count(*) n from q group by 1) select o.q, o.c, round(ov::double / (x.n + y.n - ov), 6) jaccard from o join n x on x.item_id = o.q join n y on y.item_id = o.c qualify row_number() over (partition by o.q order by round(ov::double / (x.n + y.n - ov), 6) desc, o.c) <= 4""")
def lexical_controls(spark, d):
    from ..operators.rank import top_per

    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    x = t.load(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.explode(words).alias("key"))
    j = pairs.jaccard(x).withColumn("jaccard", rounded("jaccard", 6))
    both = j.select(F.col("i").alias("q"), F.col("j").alias("c"), "jaccard").union(j.select("j", "i", "jaccard"))
    return top_per(both, "q", "jaccard", ["c"], 4).select("q", "c", "jaccard")


@query("token_containment_match", r"""with q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) w from benchmark), n as (select item_id, count(*) n from q group by 1),
dt as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents)
select q.item_id, dt.doc_id, count(*) held from q join dt using (w) join n using (item_id) group by q.item_id, dt.doc_id, n.n having count(*) * 10 >= n.n * 9""")
def token_containment_match(spark, d):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    q = t.load(spark, d, "benchmark").select("item_id", F.explode(words("text")).alias("w"))
    n = q.groupBy("item_id").agg(F.count("*").alias("n"))
    docs = t.load(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.explode(words("text")).alias("w"))
    held = q.join(docs, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("held"))
    return held.join(F.broadcast(n), "item_id").filter("held * 10 >= n * 9").select("item_id", "doc_id", "held")


@query("far_pairs", f"""with {TOK}, {DF}, {LOWRARE}, {VOCAB}, {AREA}, k as (select a.item i, b.item j, arg_min(a.key, (a.df, a.key)) as key from low a join low b on a.key = b.key and a.item < b.item group by 1, 2),
x as (select k.i, k.j, k.key from k join voc on voc.i = k.i and voc.j = k.j join area a on a.item = k.i join area b on b.item = k.j where a.area <> b.area and jaccard < 0.15::double)
select i, j, key from x qualify row_number() over (partition by key order by sha256('far:' || i || ':' || j)) <= 20""")
def far_pairs(spark, d):
    return pairs.far_pairs(tok(spark, d), area(spark, d), LOW, limit=0.15)


@query("rarity_pdf", f"""with {TOK}, {DF}, n as (select df, count(*) keys from df group by df) select df, keys, round(case when lag(df) over (order by df) is not null then (ln(keys) - ln(lag(keys) over (order by df))) / (ln(df) - ln(lag(df) over (order by df))) end, 6) slope from n""")
def rarity_pdf(spark, d):
    from pyspark.sql import Window

    n = pairs.document_frequency(tok(spark, d)).groupBy("df").agg(F.count("*").alias("keys"))
    w = Window.orderBy("df")  # one row for each frequency
    step = (F.log("keys") - F.log(F.lag("keys").over(w))) / (F.log("df") - F.log(F.lag("df").over(w)))
    return n.select("df", "keys", rounded(step, 6).alias("slope"))


@query("adamic_adar", with_sql("paper", "cit") + """, e as (select distinct area item, work as key from cit), w as (select key, 1 / ln(greatest(count(*), 2)) w from e group by key)
select a.item i, b.item j, round(sum(w.w), 6) score from e a join e b on a.key = b.key and a.item < b.item join w on w.key = a.key group by 1, 2""")
def adamic_adar(spark, d):
    e = t.citations(spark, d).select(F.col("area").alias("item"), F.col("work").alias("key"))
    return pairs.adamic_adar(e).withColumn("score", rounded("score", 6))


@query("co_cited_pairs", with_sql("paper", "cit") + " select a.work i, b.work j, count(*) n from cit a join cit b on a.paper = b.paper and a.work < b.work group by 1, 2")
def co_cited_pairs(spark, d):
    return pairs.co_cited(t.citations(spark, d).select(F.col("paper").alias("list"), F.col("work").alias("item")))


@query("in_degree", with_sql("paper", "cit") + " select p_partkey as work, count(cit.paper) degree from part left join cit on cit.work = p_partkey group by 1")
def in_degree(spark, d):
    n = t.citations(spark, d).groupBy("work").agg(F.count("*").alias("degree"))
    return t.work_areas(spark, d).select("work").join(n, "work", "left").select("work", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("generic_endpoints", with_sql("paper", "cit") + ", d as (select work, count(*) n from cit group by 1) select count(*) filter (where n > 35) generic, count(*) filter (where n <= 35) kept from d")
def generic_endpoints(spark, d):
    n = t.citations(spark, d).groupBy("work").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 35).alias("generic"), F.count_if(F.col("n") <= 35).alias("kept"))


NEWP = """old as (select distinct a.work i, b.work j from cit a join cit b on a.paper = b.paper and a.work < b.work where a.year <= 1997),
con as (select paper from cit where year > 1997 group by paper having count(*) >= 2),
pos as (select distinct a.paper, a.work i, b.work j from cit a join cit b on a.paper = b.paper and a.work < b.work where a.year > 1997 and not exists (select 1 from old where old.i = a.work and old.j = b.work))"""


def _new_pairs(spark, d, works=None):
    """paper, i < j: works cited together after 1997 and never before; of `works` (work) alone, if given."""
    cit = t.citations(spark, d) if works is None else t.citations(spark, d).join(works, "work", "left_semi")
    both = lambda c: c.select("paper", F.col("work").alias("i")).join(c.select("paper", F.col("work").alias("j")), "paper").filter("i < j")
    return both(cit.filter("year > 1997")).join(both(cit.filter("year <= 1997")).select("i", "j").distinct(), ["i", "j"], "left_anti")


@query("new_connectors", with_sql("paper", "cit") + f", {NEWP} select con.paper, count(pos.i) pairs from con left join pos on pos.paper = con.paper group by 1")
def new_connectors(spark, d):
    con = t.citations(spark, d).filter("year > 1997").groupBy("paper").agg(F.count("*").alias("n")).filter("n >= 2").select("paper")
    n = _new_pairs(spark, d).groupBy("paper").agg(F.count("*").alias("pairs"))
    return con.join(n, "paper", "left").select("paper", F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("edited_connectors", """with o as (select l_orderkey k, list(distinct l_partkey) filter (where l_linenumber <= 2) a, list(distinct l_partkey) b from lineitem group by 1) select k paper, len(list_filter(b, lambda x: not coalesce(list_contains(a, x), false)))::bigint gained from o where a is not null and len(list_filter(b, lambda x: not list_contains(a, x))) >= 2""")
def edited_connectors(spark, d):
    li = t.load(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    x = li.groupBy(F.col("l_orderkey").alias("paper")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey"))).alias("a"), F.collect_set("l_partkey").alias("b"))
    return x.filter(F.size("a") > 0).select("paper", F.size(F.array_except("b", "a")).cast("long").alias("gained")).filter("gained >= 2")


@query("connector_class", with_sql("paper", "cit", "home") + f", {NEWP} select pos.paper, case when bool_or(a.home <> b.home) then 'bridge' else 'within' end as class, count(*) pairs from pos join home a on a.work = pos.i join home b on b.work = pos.j group by 1")
def connector_class(spark, d):
    h = t.work_areas(spark, d)
    x = _new_pairs(spark, d).join(h.toDF("i", "hi"), "i").join(h.toDF("j", "hj"), "j")
    return x.groupBy("paper").agg(F.when(F.bool_or(F.col("hi") != F.col("hj")), "bridge").otherwise("within").alias("class"), F.count("*").alias("pairs"))


TRI = f"""nb0 as (select a.item c, b.item x, count(*) shared, round(sum(1.0::double / a.df), 9) weight from low a join low b on a.key = b.key and a.item <> b.item group by 1, 2),
nb as (select c, x, weight from nb0 where shared >= 2 qualify row_number() over (partition by c order by weight desc, x desc) <= 150),
sh as (select distinct a.item i, b.item j from low a join low b on a.key = b.key and a.item < b.item),
tri as (select l.x a, r.x b, l.c c, least(l.weight, r.weight) score from nb l join nb r on l.c = r.c and l.x < r.x join area p on p.item = l.x join area q on q.item = r.x join area s on s.item = l.c
 where p.area <> q.area and p.area <> s.area and q.area <> s.area and not exists (select 1 from sh where sh.i = l.x and sh.j = r.x) qualify row_number() over (partition by l.x, r.x order by l.c) = 1)"""


@query("bridge_triples", f"with {TOK}, {DF}, {LOWRARE}, {AREA}, {TRI} select * from tri")
def bridge_triples(spark, d):
    return pairs.bridge_triples(low(spark, d), area(spark, d))


CITED = with_sql("paper", "cit", "ref") + """, low as (select paper item, work as key, df from cit join (select work, count(*) df from cit group by work having count(*) between 2 and 200) using (work)), area as (select paper item, area from paper),
ck as (select paper p, cited q from ref union select cited, paper from ref), """ + TRI.replace(
    "qualify row_number() over (partition by l.x, r.x", "and not exists (select 1 from ck where p = l.x and q = r.x) and not exists (select 1 from ck where p = l.x and q = l.c) and not exists (select 1 from ck where p = r.x and q = l.c) qualify row_number() over (partition by l.x, r.x"
) + ", best as (select * from tri order by round(score, 9) desc, a, b limit 4000)"


def _cited_triples(spark, d):
    """Papers c that share at least two rare works with both a and b, which share none; three areas, and no citation among the three. The 4,000 best."""
    rare = pairs.rare(settled(t.citations(spark, d).select(F.col("paper").alias("item"), F.col("work").alias("key"))), 2, 200)
    area = t.papers(spark, d).select(F.col("paper").alias("item"), "area")
    cites = t.references(spark, d).select(F.col("paper").alias("item"), "cited")
    x = pairs.bridge_triples(rare, area, cites)
    return x.orderBy(F.desc(F.round("score", 9)), "a", "b").limit(4000)


@query("cited_triples", f"{CITED} select a, b, c, round(score, 6) score from best")
def cited_triples(spark, d):
    return _cited_triples(spark, d).withColumn("score", rounded("score", 6))


@query("triple_filter", f"""{CITED}, fl as (select o_orderkey item, o_custkey as file from orders), us as (select distinct x.file, y.file used from ref join fl x on x.item = ref.paper join fl y on y.item = ref.cited where x.file <> y.file),
r as (select case when exists (select 1 from ref m join ref n using (paper) where m.cited = a and n.cited = b) then 'co-cited' when x.file = y.file then 'same file' when exists (select 1 from us m join us n using (file) where m.used = x.file and n.used = y.file) then 'one file uses both'
 when exists (select 1 from us m where (m.file = x.file and m.used = y.file) or (m.file = y.file and m.used = x.file)) then 'files use each other' else 'kept' end reason from best join fl x on x.item = a join fl y on y.item = b) select reason, count(*) n from r group by reason""")
def triple_filter(spark, d):
    """What already links the ends of the best triples: a paper that cites both, or the files (customers) of the two."""
    files = t.load(spark, d, "orders", ["o_orderkey", "o_custkey"]).toDF("item", "file")
    edges = t.references(spark, d).select(F.col("paper").alias("item"), "cited")
    return pairs.link_reasons(_cited_triples(spark, d), edges, files).groupBy("reason").agg(F.count("*").alias("n"))


@query("asof_enclosing", """with p as (select event_id, user_id, ts from events where event_type <> (select min(event_type) from events)), h as (select user_id, ts, max(event_id) header from events where event_type = (select min(event_type) from events) group by 1, 2)
select p.event_id, h.header from p asof left join h on h.user_id = p.user_id and h.ts <= p.ts""")
def asof_enclosing(spark, d):
    e = t.load(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    first = e.agg(F.min("event_type").alias("first"))
    x = e.crossJoin(F.broadcast(first))
    heads = x.filter("event_type = first").groupBy("user_id", "ts").agg(F.max("event_id").alias("header"))
    return pairs.as_of(x.filter("event_type <> first").select("event_id", "user_id", "ts"), heads, "user_id", "ts", "header").select("event_id", "header")


@query("outermost_interval", """with s as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_partkey, l_quantity) n, l_partkey::bigint s, (l_partkey + l_quantity * 10)::bigint e from lineitem)
select k, n, s, e from s where not exists (select 1 from s o where o.k = s.k and o.n <> s.n and o.s <= s.s and o.e >= s.e and (o.s < s.s or o.e > s.e or o.n < s.n))""")
def outermost_interval(spark, d):
    """Lines have no key of their own: they are numbered within their order; lines that tie in that are equal spans."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_quantity")).cast("long")
    s = t.load(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"]).select(F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_partkey").cast("long").alias("s"), (F.col("l_partkey") + F.col("l_quantity") * 10).cast("long").alias("e"))
    return pairs.outermost(s, "k", "s", "e", "n")


@query("capped_rarest", f"with {TOK}, {DF}, {RARE} select item, key, df, row_number() over (partition by item order by df, key) place from rare qualify place <= 8")
def capped_rarest(spark, d):
    return pairs.capped_rarest(pairs.rare(tok(spark, d)), 8)


@query("label_diff", """with a as (select doc_id k, quality v from labels where doc_id % 3 <> 0), b as (select doc_id k, toxic v from labels where doc_id % 3 <> 1)
select coalesce(a.k, b.k) k, case when a.k is null then 'added' when b.k is null then 'dropped' else 'changed' end as change from a full join b on a.k = b.k where a.k is null or b.k is null or a.v <> b.v""")
def label_diff(spark, d):
    x = t.load(spark, d, "labels")
    a, b = x.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("a")), x.filter("doc_id % 3 <> 1").select("doc_id", F.col("toxic").alias("b"))
    both = a.join(b, "doc_id", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").when(F.col("a") != F.col("b"), "changed")
    return both.select(F.col("doc_id").alias("k"), change.alias("change")).filter("change IS NOT NULL")

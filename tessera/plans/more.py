"""Further filters, joins, counts and rankings of the studies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formal, stats
from ..functions.numbers import rounded
from ..operators import grid, nulls, pairs, rank
from ..operators import resample as rs
from ..operators import vectors as vec
from ..sources import tables as t
from ..sources.tables import with_sql
from . import ranks, texts
from . import vectors as pv
from .registry import query


@query("landmark_filter", f"with {texts.TOK}, n as (select item, count(*) n, max((key like 'the%')::int) j from tok group by item) select count(*) filter (where n >= 20 and source not like 'src1%') landmarks, count(*) filter (where n < 20) small from n join documents on doc_id = item")
def landmark_filter(spark, d):
    n = texts.tok(spark, d).groupBy("item").agg(F.count("*").alias("n")).join(texts.area(spark, d), "item")
    return n.agg(F.count_if((F.col("n") >= 20) & ~F.col("area").startswith("src1")).alias("landmarks"), F.count_if(F.col("n") < 20).alias("small"))


@query("relabelled_areas", r"select code, count(*) works from (select distinct p_partkey, unnest(regexp_extract_all(p_type, '[A-Z]{4,}')) code from part) group by code")
def relabelled_areas(spark, d):
    """A finer grain: every code of a work's label, once; works without a code drop out."""
    codes = F.array_distinct(F.regexp_extract_all("p_type", F.lit("[A-Z]{4,}"), F.lit(0)))
    return t.load(spark, d, "part", ["p_partkey", "p_type"]).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("works"))


@query("edited_references", with_sql("paper", "cit") + ", l as (select paper, list_sort(list(work)) w from cit group by paper) select paper, len(list_filter(w, lambda x: x % 10 <> 0))::bigint + 1 refs from l")
def edited_references(spark, d):
    """Some references dropped and one added, with multiplicity kept."""
    x = t.citations(spark, d).groupBy("paper").agg(F.sort_array(F.collect_list("work")).alias("w"))
    kept = F.concat(F.filter("w", lambda x: x % 10 != 0), F.array(F.lit(-1).cast("long")))
    return x.select("paper", F.size(kept).cast("long").alias("refs"))


@query("pair_kinds", f"with {ranks.LAB} select a.q::int + b.q::int kind, count(*) pairs from lab a join lab b on a.src = b.src and a.id < b.id group by 1")
def pair_kinds(spark, d):
    """0, 1 or 2 members of a kind: from counts by kind, no pair is built."""
    n = ranks.lab(spark, d).groupBy("src").agg(F.count_if("q").alias("k"), F.count_if(~F.col("q")).alias("m"))
    x = n.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("c")),
        F.struct(F.lit(1).alias("kind"), (F.col("k") * F.col("m")).alias("c")),
        F.struct(F.lit(2).alias("kind"), (F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("c")),
    )).alias("x")).select("x.*")
    return x.groupBy("kind").agg(F.sum("c").alias("pairs")).filter("pairs > 0")


@query("paired_arms", "with a as (select conv_id, turn, length(text) n from conversations where role = 'user'), b as (select conv_id, turn - 1 turn, length(text) n from conversations where role = 'assistant') select a.conv_id, count(*) pairs, sum(abs(a.n - b.n))::bigint shift from a join b on a.conv_id = b.conv_id and a.turn = b.turn group by 1")
def paired_arms(spark, d):
    c = t.load(spark, d, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("a"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).groupBy("conv_id").agg(F.count("*").alias("pairs"), F.sum(F.abs(F.col("a") - F.col("b"))).cast("long").alias("shift"))


@query("curated_lookup", with_sql("paper", "cit") + ", c as (select distinct work, area from cit where year <= 1997), w as (select l_partkey as work, min(l_suppkey % 25)::bigint area from lineitem group by 1) select w.work, w.area, c.work is not null known from w left join c on c.work = w.work and c.area = w.area")
def curated_lookup(spark, d):
    w = t.load(spark, d, "lineitem", ["l_partkey", "l_suppkey"]).groupBy(F.col("l_partkey").alias("work")).agg(F.min(F.col("l_suppkey") % 25).alias("area"))
    c = grid.history(t.citations(spark, d), 1997).select("work", "area", F.lit(True).alias("known")).distinct()
    return w.join(c, ["work", "area"], "left").select("work", "area", F.coalesce("known", F.lit(False)).alias("known"))


@query("matched_negatives", f"with {ranks.LAB}, p as (select *, least(floor(s / 20), 4)::bigint cell from lab), q as (select cell, count(*) n from p where y group by cell) select p.id, p.cell from p join q using (cell) where not p.y qualify row_number() over (partition by p.cell order by sha256('neg|' || p.id), p.id) <= 2 * any_value(q.n) over (partition by p.cell)")
def matched_negatives(spark, d):
    """Negatives of the positives' own popularity cells, twice as many, in hash order."""
    p = ranks.lab(spark, d).withColumn("cell", F.least(F.floor(F.col("s") / 20), F.lit(4)).cast("long"))
    n = p.filter("y").groupBy("cell").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cell").orderBy(F.sha2(F.concat_ws("|", F.lit("neg"), F.col("id").cast("string")), 256), "id")
    return p.filter("NOT y").withColumn("k", F.row_number().over(w)).join(F.broadcast(n), "cell").filter("k <= 2 * n").select("id", "cell")


@query("unordered_dedupe", "select least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b, min(l_orderkey * 10 + l_linenumber) first from lineitem group by 1, 2")
def unordered_dedupe(spark, d):
    li = t.load(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"])
    return li.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))


@query("shared_rare_label", f"with {texts.TOK}, {texts.DF}, {texts.LOWRARE}, n as (select count(*) n from labels), s as (select distinct a.item i, b.item j from low a join low b on a.key = b.key and a.item < b.item) select (select n * (n - 1) // 2 from n)::bigint pairs, count(*) sharing from s where i in (select doc_id from labels) and j in (select doc_id from labels)")
def shared_rare_label(spark, d):
    """Of all pairs of labelled documents, how many there are and how many share a rare word; the pairs that don't are counted, not made."""
    x = t.load(spark, d, "labels").select(F.col("doc_id").alias("item"))
    s = pairs.sharing(texts.low(spark, d).select("item", "key").join(x, "item", "left_semi"))
    n = x.agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("sharing")).crossJoin(n).select(F.expr("cast(n * (n - 1) / 2 as bigint)").alias("pairs"), "sharing")


@query("corpus_summary", "select count(*) docs, count(distinct text) texts, count(distinct lang) langs, count(distinct source) sources, count(*) filter (where n_chars > 2000) long_docs, sum(n_chars)::bigint chars from documents")
def corpus_summary(spark, d):
    x = t.load(spark, d, "documents")
    return x.agg(F.count("*").alias("docs"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"), F.sum("n_chars").alias("chars"))


@query("pair_baselines", with_sql("paper", "cit") + ", dg as (select work, count(*) n from cit group by 1), p as (select a.work i, b.work j, count(*) n from cit a join cit b on a.paper = b.paper and a.work < b.work group by 1, 2) select p.i, p.j, round(ln(1 + x.n) + ln(1 + y.n), 6) popular, round(p.n::double / (x.n + y.n - p.n), 6) jaccard from p join dg x on x.work = p.i join dg y on y.work = p.j")
def pair_baselines(spark, d):
    cit = t.citations(spark, d)
    n = cit.groupBy("work").agg(F.count("*").alias("n"))
    p = pairs.co_cited(cit.select(F.col("paper").alias("list"), F.col("work").alias("item"))).withColumnRenamed("n", "c")
    p = p.join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
    return p.select("i", "j", rounded(F.log1p("ni") + F.log1p("nj"), 6).alias("popular"), rounded(F.col("c") / (F.col("ni") + F.col("nj") - F.col("c")), 6).alias("jaccard"))


@query("query_ranks", with_sql("paper", "cit") + ", n as (select area, work, count(*) n from cit group by 1, 2) select area, work, rank() over (partition by area order by n) + (count(*) over (partition by area, n) - 1) / 2.0::double rank from n")
def query_ranks(spark, d):
    n = t.citations(spark, d).groupBy("area", "work").agg(F.count("*").alias("n"))
    return rank.midranks(n, "n", "rank", ["area"]).select("area", "work", "rank")


@query("degree_quintiles", with_sql("paper", "cit") + ", n as (select work, count(*) n from cit group by 1), e as (select quantile_disc(n, [0.2, 0.4, 0.6, 0.8]) e from n) select work, len(list_filter(e.e, lambda x: x <= n))::bigint band from n, e")
def degree_quintiles(spark, d):
    n = t.citations(spark, d).groupBy("work").agg(F.count("*").alias("n"))
    e = rank.quantiles(n, "n", [0.2, 0.4, 0.6, 0.8], interpolate=False)
    band = F.size(F.filter("edges", lambda x: x <= F.col("n"))).cast("long")
    return n.crossJoin(F.broadcast(e)).select("work", band.alias("band"))


@query("running_profile", with_sql("paper", "cit") + ", n as (select area, year, count(*) n, count(distinct work) w from cit group by 1, 2) select area, year, sum(n) over (partition by area order by year)::bigint papers, sum(w) over (partition by area order by year)::bigint works from n")
def running_profile(spark, d):
    n = t.citations(spark, d).groupBy("area", "year").agg(F.count("*").alias("n"), F.countDistinct("work").alias("w"))
    w = Window.partitionBy("area").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("area", "year", F.sum("n").over(w).alias("papers"), F.sum("w").over(w).alias("works"))


@query("boundary_bin", f"with {pv.U}, {pv.PAIRS}, h as (select floor(angle)::bigint bin, count(*) n from p group by 1), c as (select bin, sum(n) over (order by bin) cum from h) select min(bin) bin from c where cum >= 1000")
def boundary_bin(spark, d):
    h = vec.angle_histogram(pv.rows(spark, d), "area", 1.0)
    c = rank.cumulative(h, "bin", ["pairs"])
    return c.filter(F.col("pairs_below") + F.col("pairs") >= 1000).agg(F.min("bin").alias("bin"))


@query("last_heading", "with h as (select conv_id, turn, text from conversations where role = 'user'), a as (select conv_id, turn from conversations where role = 'assistant') select a.conv_id, a.turn, md5(h.text) heading from a asof left join h on h.conv_id = a.conv_id and h.turn <= a.turn")
def last_heading(spark, d):
    c = t.load(spark, d, "conversations")
    heads = c.filter("role = 'user'").groupBy("conv_id", "turn").agg(F.md5(F.max("text")).alias("heading"))
    return pairs.as_of(c.filter("role = 'assistant'").select("conv_id", "turn"), heads, "conv_id", "turn", "heading")


@query("first_states", "select conv_id, role, min(turn) turn from conversations group by 1, 2")
def first_states(spark, d):
    return t.load(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))


@query("file_split", "with s as (select source, sha256('split|' || source) h from (select distinct source from documents)), r as (select source, row_number() over (order by h, source) - 1 k, count(*) over () n from s) select source, case when k < 0.8::double * n then 'train' else 'held' end part from r")
def file_split(spark, d):
    """Whole files held out; files are few next to documents, and are numbered after distinct."""
    s = t.load(spark, d, "documents", ["source"]).distinct()
    w = Window.orderBy(F.sha2(F.concat_ws("|", F.lit("split"), "source"), 256), "source")
    x = s.withColumn("k", F.row_number().over(w) - 1).crossJoin(F.broadcast(s.agg(F.count("*").alias("n"))))
    return x.select("source", F.when(F.col("k") < 0.8 * F.col("n"), "train").otherwise("held").alias("part"))


@query("blind_order", f"with {ranks.LAB} select id, sha256('blind|' || id) as key from lab order by key, id limit 50")
def blind_order(spark, d):
    return ranks.lab(spark, d).select("id", F.sha2(F.concat_ws("|", F.lit("blind"), F.col("id").cast("string")), 256).alias("key")).orderBy("key", "id").limit(50)


@query("accumulated_sets", "select l_partkey as work, len(list_distinct(list(l_suppkey)))::bigint suppliers from lineitem group by 1")
def accumulated_sets(spark, d):
    return t.load(spark, d, "lineitem", ["l_partkey", "l_suppkey"]).groupBy(F.col("l_partkey").alias("work")).agg(F.size(F.collect_set("l_suppkey")).cast("long").alias("suppliers"))


@query("endpoint_permutation", f"with {ranks.LAB}, dr as (select unnest(range(20)) draw), a as (select id, s, row_number() over (order by id) k from lab), o as (select draw, id, row_number() over (partition by draw order by sha256('ends|' || draw || '|' || id), id) k from dr, lab), m as (select o.draw, avg(abs(a.s - b.s)) v from o join a on a.k = o.k join a b on b.id = o.id group by o.draw) select round(avg(v), 6) mean, round(stddev_pop(v), 6) sd from m")
def endpoint_permutation(spark, d, draws: int = 20):
    x = ranks.lab(spark, d).select("id", "s")
    o = nulls.permutation(x.select(F.col("id").alias("e")), draws, "ends").join(x.toDF("e", "t"), "e").join(x.toDF("to", "s"), "to")
    m = o.groupBy("draw").agg(F.avg(F.abs(F.col("s") - F.col("t"))).alias("v"))
    return m.agg(rounded(F.avg("v"), 6).alias("mean"), rounded(F.stddev_pop("v"), 6).alias("sd"))


@query("exact_tests", None)
def exact_tests(spark, d):
    """Fisher, sign and Poisson p of each language's labels; the tests are on counts, one row a language."""
    x = ranks.lab(spark, d)
    all_ = x.agg(F.count_if("y").alias("ty"), F.count_if(~F.col("y")).alias("tn"))
    n = x.groupBy("g").agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b"), F.count_if("q").alias("k"), F.count("*").alias("n")).crossJoin(F.broadcast(all_))
    mean = F.col("n") * F.col("ty") / (F.col("ty") + F.col("tn"))
    return n.select("g", stats.fisher_udf("a", "b", F.col("ty") - F.col("a"), F.col("tn") - F.col("b")).alias("fisher"), stats.sign_udf("k", "n").alias("sign"), stats.poisson_udf("a", mean).alias("poisson"))


@query("sizing", f"with {ranks.LAB}, m as (select count(*) n, count(*) filter (where y) k from lab) select f::bigint f, (n * f)::bigint items, (n * f * (n * f - 1) // 2)::bigint pairs, round(1 / sqrt(12.0::double * k * f) , 6) sd from m, (select unnest([1, 2, 4, 8]) f)")
def sizing(spark, d):
    """Items, pairs and the deviation of an AUC when the corpus grows f times."""
    m = ranks.lab(spark, d).agg(F.count("*").alias("n"), F.count_if("y").alias("k")).withColumn("f", F.explode(F.array(*(F.lit(f).cast("long") for f in (1, 2, 4, 8)))))
    items = F.col("n") * F.col("f")
    return m.select("f", items.alias("items"), F.floor(items * (items - 1) / 2).alias("pairs"), rounded(1 / F.sqrt(12.0 * F.col("k") * F.col("f")), 6).alias("sd"))


@query("ensemble", f"with {ranks.LAB}, r as (select id, (rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double - 0.5::double) / count(*) over () a, (rank() over (order by w) + (count(*) over (partition by w) - 1) / 2.0::double - 0.5::double) / count(*) over () b from lab) select id, round((a + b) / 2, 6) score from r")
def ensemble(spark, d):
    """Mean of the scores' average percentile ranks."""
    x = ranks.lab(spark, d)
    x = rank.midranks(rank.midranks(x, "s", "a"), "w", "b").crossJoin(F.broadcast(x.agg(F.count("*").alias("n"))))
    return x.select("id", rounded(((F.col("a") - 0.5) / F.col("n") + (F.col("b") - 0.5) / F.col("n")) / 2, 6).alias("score"))


@query("mean_placement", f"with {pv.U}, {pv.CENT}, x as (select u.id, c.area, u.area own, round({pv.RAD.format('u.u', 'c.c')}, 9) sim from u cross join cu c) select id, row_number() over (partition by id order by sim desc, area) rank from x qualify own = area")
def mean_placement(spark, d):
    """Place of each vector's own area among the areas' means."""
    from ..functions import vector as v

    x = pv.rows(spark, d)
    c = vec.centroids(x, "area").select(F.col("area").alias("a"), "c")
    x = x.withColumn("k", F.lit(1)).join(F.broadcast(c.withColumn("k", F.lit(1))), "k").select("id", "area", "a", F.round(v.dot("u", "c"), 9).alias("sim"))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "a")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).filter("a = area").select("id", "rank")


@query("centroid_shift", f"with {pv.U}, h as (select area * 2 + id % 2 area, u from u), {pv.CENT.replace('from u)', 'from h)')}, p as (select a.area // 2 area, round(degrees(acos(least(1, {pv.RAD.format('a.c', 'b.c')}))), 6) shift from cu a join cu b on b.area = a.area + 1 and a.area % 2 = 0) select quantile_cont(shift, 0.25) q1, quantile_cont(shift, 0.5) q2, quantile_cont(shift, 0.75) q3 from (select area, shift from p)")
def centroid_shift(spark, d):
    """Quartiles of the angle between the means of two halves of each area."""
    from ..functions import vector as v

    x = pv.rows(spark, d).withColumn("half", F.col("id") % 2)
    c = [vec.centroids(x.filter(F.col("half") == k), "area").select("area", F.col("c").alias(f"c{k}")) for k in (0, 1)]
    s = c[0].join(c[1], "area").select(rounded(v.angle(v.dot("c0", "c1")), 6).alias("s"))
    return s.agg(*(F.percentile("s", F.lit(q)).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)))


@query("truth_vectors", """with f as (select p_partkey, p_partkey % 8 a, p_size % 8 b, p_partkey % 4 op from part),
x as (select p_partkey, op, unnest(range(256)) v, a, b from f), y as (select p_partkey, op, (v >> a) & 1 l, 1 - ((v >> b) & 1) r from x)
select p_partkey, count(*) filter (where case op when 0 then l <= r when 1 then l = 1 and r = 1 when 2 then l = 1 or r = 1 else l = r end) holds from y group by p_partkey""")
def truth_vectors(spark, d):
    """Formulas made of the parts' numbers, and under how many valuations each holds."""
    op = F.element_at(F.array(*map(F.lit, "→∧∨↔")), (F.col("p_partkey") % 4 + 1).cast("int"))
    f = t.load(spark, d, "part", ["p_partkey", "p_size"]).withColumn("f", F.format_string("p%d %s ¬p%d", F.col("p_partkey") % 8, op, F.col("p_size") % 8))
    kinds = f.select("f").distinct().withColumn("holds", F.size(F.filter(formal.truth_vector(F.col("f")), lambda x: x > 0)).cast("long"))
    return f.join(kinds, "f").select("p_partkey", "holds")


@query("whole_name_hits", r"select source, count(*) n from documents where regexp_matches(text, '(^|[^\p{L}\p{N}_''!?.\x{2100}-\x{214F}])the($|[^\p{L}\p{N}_''!?.\x{2100}-\x{214F}])') group by source")
def whole_name_hits(spark, d):
    return t.load(spark, d, "documents", ["source", "text"]).filter(formal.whole_name("text", "the")).groupBy("source").agg(F.count("*").alias("n"))


@query("vector_contrast", f"with {pv.U}, {pv.PAIRS} select same, count(*) pairs, round(min(angle), 6) nearest, round(max(angle), 6) farthest from p group by same")
def vector_contrast(spark, d):
    import numpy as np
    import pandas as pd

    def fn(a, b, s):
        ok = ~np.isnan(s)
        same = (a["area"].to_numpy()[:, None] == b["area"].to_numpy()[None, :])[ok] if s.size else np.empty(0, bool)
        x = pd.DataFrame({"same": same, "angle": np.round(np.degrees(np.arccos(s[ok])), 6)})
        return x.groupby("same")["angle"].agg(pairs="count", nearest="min", farthest="max").reset_index()

    parts = vec.block_pairs(pv.rows(spark, d), fn, "same boolean, pairs long, nearest double, farthest double", ["area"])
    return parts.groupBy("same").agg(F.sum("pairs").alias("pairs"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))

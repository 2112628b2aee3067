"""Ranking and resampling queries on labels, documents and citation cells, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import nulls, rank
from ..operators import resample as rs
from ..sources import tables as t
from ..sources.tables import with_sql
from .registry import query

#: score: text length in hundreds (it has ties), y: toxic, g: language, w: 1 or 2 by quality.
LAB = "lab as (select d.doc_id id, (n_chars // 100)::double s, toxic = 1 y, quality = 1 q, lang g, source src, (1 + quality)::double w from labels l join documents d using (doc_id))"
CLS = "gs as (select g, s, sum(case when y then w else 0 end) pw, sum(case when y then 0 else w end) nw from x group by g, s), c as (select *, coalesce(sum(nw) over (partition by g order by s rows between unbounded preceding and 1 preceding), 0) below from gs)"
VALUE = "case when sum(pw) * sum(nw) > 0 then sum(pw * (below + 0.5 * nw)) / (sum(pw) * sum(nw)) end"


def lab(spark, d):
    x = t.load(spark, d, "labels").join(t.load(spark, d, "documents", ["doc_id", "n_chars", "lang", "source"]), "doc_id")
    return x.select(
        F.col("doc_id").alias("id"), F.floor(F.col("n_chars") / 100).cast("double").alias("s"), (F.col("toxic") == 1).alias("y"), (F.col("quality") == 1).alias("q"),
        F.col("lang").alias("g"), F.col("source").alias("src"), (1 + F.col("quality")).cast("double").alias("w"),
    )


@query("plain_auc", f"with {LAB}, x as (select 0 g, s, y, 1.0::double w from lab), {CLS} select round({VALUE}, 6) auc, sum(pw) positives, sum(nw) negatives from c")
def plain_auc(spark, d):
    return rank.auc(lab(spark, d), "s", "y").select(rounded("auc", 6).alias("auc"), "positives", "negatives")


@query("weighted_auc", f"with {LAB}, x as (select 0 g, s, y, w from lab), {CLS} select round({VALUE}, 6) auc, sum(pw) positives, sum(nw) negatives from c")
def weighted_auc(spark, d):
    return rank.auc(lab(spark, d), "s", "y", "w").select(rounded("auc", 6).alias("auc"), "positives", "negatives")


@query("grouped_auc", f"with {LAB}, x as (select g, s, y, 1.0::double w from lab), {CLS} select g, round({VALUE}, 6) auc, sum(pw) positives, sum(nw) negatives from c group by g")
def grouped_auc(spark, d):
    return rank.auc(lab(spark, d), "s", "y", None, ["g"]).select("g", rounded("auc", 6).alias("auc"), "positives", "negatives")


@query("stratified_auc", f"with {LAB}, x as (select g, s, y, w from lab), {CLS}, e as (select sum(pw * (below + 0.5 * nw)) won, sum(pw) * sum(nw) pairs from c group by g) select round(sum(won) / sum(pairs), 6) auc from e")
def stratified_auc(spark, d):
    return rank.stratified_auc(lab(spark, d), "s", "y", "g", "w").select(rounded("auc", 6).alias("auc"))


@query("placements", f"with {LAB}, x as (select 0 g, s, y, 1.0::double w from lab), {CLS}, n as (select sum(nw) n from c) select s, round((below + 0.5 * nw) / n.n, 6) placement, pw n from c, n where pw > 0")
def placements(spark, d):
    return rank.placements(lab(spark, d), "s", "y").withColumn("placement", rounded("placement", 6))


@query("midranks", f"with {LAB} select id, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double rank from lab")
def midranks(spark, d):
    return rank.midranks(lab(spark, d), "s").select("id", "rank")


@query("kind_percentile", f"with {LAB}, r as (select id, g, y, rank() over (partition by g order by s) - 1 below, count(*) over (partition by g, s) h, count(*) over (partition by g) n from lab), b as (select id, y, least(floor(round((below + 0.5::double * h) / n, 9) * 1000000), 999999)::bigint s0 from r), x as (select 0 g, s0::double s, y, 1.0::double w from b), {CLS} select round({VALUE}, 6) auc from c")
def kind_percentile(spark, d):
    x = lab(spark, d)
    n = x.groupBy("g", "s").agg(F.count("*").alias("h"))
    c = rank.cumulative(n, "s", ["h"], ["g"]).join(F.broadcast(x.groupBy("g").agg(F.count("*").alias("n"))), "g")
    p = F.least(F.floor(rounded((F.col("h_below") + 0.5 * F.col("h")) / F.col("n"), 9) * 1_000_000), F.lit(999_999))
    x = x.join(c.select("g", "s", p.alias("p")), ["g", "s"])
    return rank.auc(x, "p", "y").select(rounded("auc", 6).alias("auc"))


@query("rank_deciles", f"with {LAB} select id, ((row_number() over (order by s, id) - 1) * 10 // count(*) over ())::bigint decile from lab")
def rank_deciles(spark, d):
    return _placed(spark, d).select("id", F.floor((F.col("place") - 1) * 10 / F.col("n")).cast("long").alias("decile"))


def _placed(spark, d):
    """Places from 1 by (s, id): a global order, cut into buckets of s, numbered within each."""
    x = rank.bucketed(lab(spark, d), "s")
    n = x.groupBy("__b").agg(F.count("*").alias("c"))
    before = n.select("__b", F.coalesce(F.sum("c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    x = x.join(F.broadcast(before), "__b").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("__b").orderBy("s", "id")))
    return x.crossJoin(F.broadcast(n.agg(F.sum("c").alias("n"))))


@query("percentile_rank", f"with {LAB} select id, round((row_number() over (order by s, id) - 0.5::double) / count(*) over (), 6) p from lab")
def percentile_rank(spark, d):
    return _placed(spark, d).select("id", rounded((F.col("place") - 0.5) / F.col("n"), 6).alias("p"))


@query("quantile_bands", f"with {LAB}, e as (select quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) e from lab) select id, len(list_filter(e.e, lambda x: x <= s))::bigint band from lab, e")
def quantile_bands(spark, d):
    return rank.quantile_band(lab(spark, d), "s", [0.2, 0.4, 0.6, 0.8]).select("id", "band")


@query("popularity_deciles", with_sql("paper", "cit") + ", p as (select work, count(*) n from cit group by 1), r as (select work, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0::double r, count(*) over () m from p) select work, least(floor((r - 0.5) * 10 / m), 9)::bigint decile from r")
def popularity_deciles(spark, d):
    p = t.citations(spark, d).groupBy("work").agg(F.count("*").alias("n"))
    x = rank.midranks(p, "n").crossJoin(F.broadcast(p.agg(F.count("*").alias("m"))))
    return x.select("work", F.least(F.floor((F.col("rank") - 0.5) * 10 / F.col("m")), F.lit(9)).cast("long").alias("decile"))


@query("percentile_of_true", f"with {LAB}, q as (select * from lab where y) select q.id, round((count(*) filter (where l.s < q.s) + 0.5::double * count(*) filter (where l.s = q.s)) / count(*), 6) p, count(*) filter (where l.s > q.s) < 10 top10 from q join lab l on l.g = q.g group by q.id, q.s")
def percentile_of_true(spark, d):
    x = lab(spark, d)
    n = x.groupBy("g", "s").agg(F.count("*").alias("h"))
    c = rank.cumulative(n, "s", ["h"], ["g"]).join(F.broadcast(x.groupBy("g").agg(F.count("*").alias("n"))), "g")
    out = x.filter("y").join(c, ["g", "s"])
    p = (F.col("h_below") + 0.5 * F.col("h")) / F.col("n")
    return out.select("id", rounded(p, 6).alias("p"), (F.col("n") - F.col("h_below") - F.col("h") < 10).alias("top10"))


@query("top_k_lift", f"with {LAB}, r as (select y, row_number() over (order by s desc, id) n from lab) select count(*) filter (where y and n <= 50) hits, round((count(*) filter (where y and n <= 50) / 50.0::double) / (count(*) filter (where y) / count(*)::double), 6) lift from r")
def top_k_lift(spark, d):
    x = lab(spark, d)
    top = rank.top_k(x, "s", ["id"], 50).agg(F.count_if("y").alias("hits"))
    base = x.agg(F.avg(F.col("y").cast("int")).alias("base"))
    return top.crossJoin(base).select("hits", rounded(F.col("hits") / 50 / F.col("base"), 6).alias("lift"))


@query("spearman", f"with {LAB}, r as (select rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double a, rank() over (order by q, y) + (count(*) over (partition by q, y) - 1) / 2.0::double b from lab) select round(corr(a, b), 6) rho from r")
def spearman(spark, d):
    x = lab(spark, d).withColumn("o", F.col("q").cast("int") * 2 + F.col("y").cast("int"))
    x = rank.midranks(rank.midranks(x, "s", "a"), "o", "b")
    return x.agg(rounded(F.corr("a", "b"), 6).alias("rho"))


@query("kappa", f"with {LAB}, m as (select avg((q = y)::int) o, avg(q::int) a, avg(y::int) b from lab) select round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) kappa from m")
def kappa(spark, d):
    m = lab(spark, d).agg(F.avg((F.col("q") == F.col("y")).cast("int")).alias("o"), F.avg(F.col("q").cast("int")).alias("a"), F.avg(F.col("y").cast("int")).alias("b"))
    e = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return m.select(rounded((F.col("o") - e) / (1 - e), 6).alias("kappa"))


@query("weighted_kappa", f"with {LAB}, r as (select least(s, 4) a, least(q::int * 2 + y::int, 4) b from lab), ma as (select a, count(*)::double n from r group by a), mb as (select b, count(*)::double n from r group by b), o as (select sum((a - b) * (a - b)) x, count(*)::double n from r), e as (select sum(ma.n * mb.n * (a - b) * (a - b)) x from ma, mb) select round(1 - o.x * o.n / e.x, 6) kappa from o, e")
def weighted_kappa(spark, d):
    r = lab(spark, d).select(F.least("s", F.lit(4.0)).alias("a"), (F.col("q").cast("double") * 2 + F.col("y").cast("double")).alias("b"))
    gap = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
    o = r.agg(F.sum(gap).alias("x"), F.count("*").cast("double").alias("n"))
    ma, mb = r.groupBy("a").agg(F.count("*").cast("double").alias("na")), r.groupBy("b").agg(F.count("*").cast("double").alias("nb"))
    e = ma.crossJoin(F.broadcast(mb)).agg(F.sum(F.col("na") * F.col("nb") * gap).alias("e"))
    return o.crossJoin(e).select(rounded(1 - F.col("x") * F.col("n") / F.col("e"), 6).alias("kappa"))


PV = f"pv as (select src as name, round(exp(-abs(avg(s) - 20) * sqrt(count(*)) / 10), 9) p from lab group by src)"


@query("holm", f"with {LAB}, {PV}, r as (select name, p, row_number() over (order by p, name) - 1 k, count(*) over () m from pv) select name, p, min((p <= 0.05::double / (m - k))::int) over (order by p, name) = 1 rejected from r")
def holm(spark, d):
    p = rounded(F.exp(-F.abs(F.avg("s") - 20) * F.sqrt(F.count("*")) / 10), 9)
    return rs.holm(lab(spark, d).groupBy(F.col("src").alias("name")).agg(p.alias("p")), "name", "p")


@query("ols_slope", f"with {LAB}, b as (select unnest([1, 2, 4, 8]) f), x as (select ln(f) / ln(2) lx, avg(s) m from b join lab on (('0x' || substr(sha256('sub|' || id), 1, 8))::bigint / 4294967296.0::double) < f / 8.0::double group by f) select round(regr_slope(m, lx), 6) slope, round(regr_intercept(m, lx), 6) intercept from x")
def ols_slope(spark, d):
    x = lab(spark, d).withColumn("f", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).filter(rs.uniform("sub", "id") < F.col("f") / 8)
    x = x.groupBy("f").agg(F.avg("s").alias("m")).withColumn("lx", F.log2(F.col("f").cast("double")))
    return x.agg(rounded(F.regr_slope("m", "lx"), 6).alias("slope"), rounded(F.regr_intercept("m", "lx"), 6).alias("intercept"))


@query("jackknife_auc", f"with {LAB}, o as (select distinct src from lab), x as (select o.src g, s, y, 1.0::double w from o join lab on lab.src <> o.src), {CLS} select g left_out, round({VALUE}, 6) auc from c group by g")
def jackknife_auc(spark, d):
    x = lab(spark, d)
    c = x.groupBy("src", "s").agg(F.sum(F.col("y").cast("double")).alias("p"), F.sum((~F.col("y")).cast("double")).alias("m"))
    o = x.select(F.col("src").alias("left_out")).distinct()
    c = c.crossJoin(F.broadcast(o)).filter("src <> left_out").groupBy("left_out", "s").agg(F.sum("p").alias("pw"), F.sum("m").alias("nw"))
    return _by(c, "left_out").select("left_out", rounded("auc", 6).alias("auc"))


def _by(classes, by):
    """AUC of each `by` from class weights (by, s, pw, nw)."""
    c = rank.cumulative(classes, "s", ["nw"], [by])
    won, n = F.sum(F.col("pw") * (F.col("nw_below") + 0.5 * F.col("nw"))), F.sum("pw") * F.sum("nw")
    return c.groupBy(by).agg(F.when(n > 0, won / n).alias("auc"))


U = lambda seed, *k: f"(('0x' || substr(sha256('{seed}|' || " + " || '|' || ".join(k) + "), 1, 8))::bigint / 4294967296.0::double)"
BOOT = f"""grp as (select src, row_number() over (order by src) - 1 k, count(*) over () n from (select distinct src from lab)), dr as (select unnest(range(50)) draw),
mu as (select draw, k2.src, count(*) mult from (select draw, floor({U('boot', 'draw', 'k')} * n)::bigint k from dr, grp) s join grp k2 using (k) group by 1, 2)"""


@query("hash_bootstrap_auc", f"with {LAB}, {BOOT}, x as (select draw g, s, y, mult::double w from mu join lab using (src)), {CLS}, a as (select g draw, {VALUE} auc from c group by g) select count(*) draws, round(avg(auc), 6) mean, round(quantile_cont(auc, 0.025), 6) low, round(quantile_cont(auc, 0.975), 6) high from a")
def hash_bootstrap_auc(spark, d, draws: int = 50):
    x = lab(spark, d)
    c = x.groupBy("src", "s").agg(F.sum(F.col("y").cast("double")).alias("pw"), F.sum((~F.col("y")).cast("double")).alias("nw"))
    a = _by(rs.weighted_classes(c, rs.multiplicities(rs.numbered(x, "src"), "src", draws, "boot"), "src", "s"), "draw")
    return a.agg(F.count("*").alias("draws"), rounded(F.avg("auc"), 6).alias("mean"), rounded(F.percentile("auc", F.lit(0.025)), 6).alias("low"), rounded(F.percentile("auc", F.lit(0.975)), 6).alias("high"))


@query("bootstrap_gain", f"with {LAB}, {BOOT}, xa as (select draw g, s, y, mult::double w from mu join lab using (src)), xb as (select draw g, q::int::double s, y, mult::double w from mu join lab using (src)), a as (select g, auc from (with x as (select * from xa), {CLS} select g, {VALUE} auc from c group by g)), b as (select g, auc from (with x as (select * from xb), {CLS} select g, {VALUE} auc from c group by g)) select round(avg(a.auc - b.auc), 6) gain, round(quantile_cont(a.auc - b.auc, 0.025), 6) low, round(quantile_cont(a.auc - b.auc, 0.975), 6) high from a join b using (g)")
def bootstrap_gain(spark, d, draws: int = 50):
    """Paired: both scores are weighed by the same draws."""
    x = lab(spark, d)
    mult = rs.multiplicities(rs.numbered(x, "src"), "src", draws, "boot")
    sums = [F.sum(F.col("y").cast("double")).alias("pw"), F.sum((~F.col("y")).cast("double")).alias("nw")]
    a = _by(rs.weighted_classes(x.groupBy("src", "s").agg(*sums), mult, "src", "s"), "draw")
    b = _by(rs.weighted_classes(x.drop("s").withColumn("s", F.col("q").cast("double")).groupBy("src", "s").agg(*sums), mult, "src", "s"), "draw")
    g = a.join(b.withColumnRenamed("auc", "base"), "draw").select((F.col("auc") - F.col("base")).alias("g"))
    return g.agg(rounded(F.avg("g"), 6).alias("gain"), rounded(F.percentile("g", F.lit(0.025)), 6).alias("low"), rounded(F.percentile("g", F.lit(0.975)), 6).alias("high"))


@query("endpoint_bootstrap", f"with {LAB}, {BOOT}, pr as (select a.src i, b.src j, avg(abs(a.s - b.s)) v from lab a join lab b on a.src < b.src and a.y and b.y group by 1, 2), x as (select x.draw, sum(v * x.mult * y.mult) / sum(x.mult * y.mult) m from pr join mu x on x.src = i join mu y on y.src = j and y.draw = x.draw group by x.draw) select round(avg(m), 6) mean, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from x")
def endpoint_bootstrap(spark, d, draws: int = 50):
    """A pair weighs the product of its two ends' multiplicities."""
    x = lab(spark, d)
    y = x.filter("y").groupBy("src", "s").agg(F.count("*").alias("n"))
    p = y.toDF("i", "si", "ni").join(y.toDF("j", "sj", "nj"), F.col("i") < F.col("j"))
    p = p.groupBy("i", "j").agg((F.sum(F.col("ni") * F.col("nj") * F.abs(F.col("si") - F.col("sj"))) / F.sum(F.col("ni") * F.col("nj"))).alias("v"))
    m = rs.multiplicities(rs.numbered(x, "src"), "src", draws, "boot")
    w = p.join(m.toDF("draw", "i", "mi"), "i").join(m.toDF("draw", "j", "mj"), ["draw", "j"])
    w = w.groupBy("draw").agg((F.sum(F.col("v") * F.col("mi") * F.col("mj")) / F.sum(F.col("mi") * F.col("mj"))).alias("m"))
    return w.agg(rounded(F.avg("m"), 6).alias("mean"), rounded(F.percentile("m", F.lit(0.025)), 6).alias("low"), rounded(F.percentile("m", F.lit(0.975)), 6).alias("high"))


@query("area_bootstrap", with_sql("paper", "cit") + f""", pr as (select area src, avg((year > 1999)::int) p from cit group by 1), lab as (select src from pr), {BOOT}, m as (select draw, sum(p * mult) / sum(mult) p from mu join pr using (src) group by draw) select round(avg(p), 6) mean, round(quantile_cont(p, 0.025), 6) low, round(quantile_cont(p, 0.975), 6) high from m""")
def area_bootstrap(spark, d, draws: int = 50):
    p = t.citations(spark, d).groupBy(F.col("area").alias("src")).agg(F.avg((F.col("year") > 1999).cast("int")).alias("p"))
    m = rs.multiplicities(rs.numbered(p, "src"), "src", draws, "boot").join(F.broadcast(p), "src")
    m = m.groupBy("draw").agg((F.sum(F.col("p") * F.col("mult")) / F.sum("mult")).alias("p"))
    return m.agg(rounded(F.avg("p"), 6).alias("mean"), rounded(F.percentile("p", F.lit(0.025)), 6).alias("low"), rounded(F.percentile("p", F.lit(0.975)), 6).alias("high"))


@query("permutation_null", f"with {LAB}, dr as (select unnest(range(20)) draw), k as (select count(*) filter (where y) k from lab), r as (select draw, s, row_number() over (partition by draw order by sha256('perm|' || draw || '|' || id), id) n from dr, lab), x as (select draw g, s, n <= k.k y, 1.0::double w from r, k), {CLS}, a as (select g, {VALUE} auc from c group by g) select round(avg(auc), 6) mean, round(stddev_pop(auc), 6) sd, count(*) filter (where auc >= 0.5::double) above from a")
def permutation_null(spark, d, draws: int = 20):
    a = nulls.label_permutation(lab(spark, d).select("id", "s", "y"), draws, "perm")
    return a.agg(rounded(F.avg("auc"), 6).alias("mean"), rounded(F.stddev_pop("auc"), 6).alias("sd"), F.count_if(F.col("auc") >= 0.5).alias("above"))


@query("cluster_null", f"""with {LAB}, dr as (select unnest(range(20)) draw), n as (select count(*) n from lab), num as (select id, s, y, row_number() over (order by id) - 1 k from lab),
sw as (select draw, num.s s0, b.s s1, num.y from dr, num, n join num b on b.k = floor({U('null', 'draw', 'num.id')} * n.n)::bigint), x as (select draw g, s1 s, y, 1.0::double w from sw), {CLS}, a as (select g, {VALUE} auc from c group by g) select round(avg(auc), 6) mean, round(stddev_pop(auc), 6) sd from a""".replace("from dr, num, n join num b on b.k = floor(", "from dr cross join num cross join n join num b on b.k = floor("))
def cluster_null(spark, d, draws: int = 20):
    """Each item is replaced by a random one, the same in all its rows of a draw."""
    x = lab(spark, d)
    num = x.select("id", "s", "y").withColumn("k", F.row_number().over(Window.orderBy("id")).cast("long") - 1)
    n = x.agg(F.count("*").alias("n"))
    sw = num.withColumn("draw", rs.draws(draws)).crossJoin(F.broadcast(n)).withColumn("to", F.floor(rs.uniform("null", "draw", "id") * F.col("n")).cast("long"))
    sw = sw.select("draw", "y", "to").join(num.select(F.col("k").alias("to"), "s"), "to")
    return rank.auc(sw, "s", "y", None, ["draw"]).agg(rounded(F.avg("auc"), 6).alias("mean"), rounded(F.stddev_pop("auc"), 6).alias("sd"))


@query("hash_sample", f"with {LAB} select id from lab order by sha256('seed|' || id), id limit 100")
def hash_sample(spark, d):
    return rs.hash_sample(lab(spark, d), "id", "seed", 100).select("id")


@query("stratified_draw", f"""with {LAB}, z as (select g, count(*) n from lab group by g), q as (select g, n * 100.0::double / sum(n) over () q from z), f as (select g, floor(q)::bigint f, row_number() over (order by round(q - floor(q), 9) desc, g) k, 100 - sum(floor(q)) over () rest from q),
quota as (select g, f + (k <= rest)::int quota from f) select id, g from lab join quota using (g) qualify row_number() over (partition by g order by sha256('strat|' || id), id) <= any_value(quota) over (partition by g)""")
def stratified_draw(spark, d):
    x = lab(spark, d)
    q = rs.largest_remainder(x.groupBy("g").agg(F.count("*").alias("n")), "g", "n", 100)
    w = Window.partitionBy("g").orderBy(F.sha2(F.concat_ws("|", F.lit("strat"), F.col("id").cast("string")), 256), "id")
    return x.withColumn("k", F.row_number().over(w)).join(F.broadcast(q), "g").filter("k <= quota").select("id", "g")


@query("calibration_bands", f"with {LAB} select width_bucket band, count(*) n, round(avg(least(s / 100, 1)), 6) predicted, round(avg(y::int), 6) observed from (select *, least(floor(s / 10), 9)::bigint width_bucket from lab) group by 1")
def calibration_bands(spark, d):
    x = lab(spark, d).withColumn("band", F.least(F.floor(F.col("s") / 10), F.lit(9)).cast("long"))
    return x.groupBy("band").agg(F.count("*").alias("n"), rounded(F.avg(F.least(F.col("s") / 100, F.lit(1.0))), 6).alias("predicted"), rounded(F.avg(F.col("y").cast("int")), 6).alias("observed"))


@query("verdicts", f"with {LAB}, x as (select g, s, y, 1.0::double w from lab), {CLS}, a as (select g, {VALUE} - 0.5::double e, sum(pw) n from c group by g) select g, case when n < 20 then 'underpowered' when e - 0.05::double > 0.05::double then 'yes' when e - 0.05::double > 0 then 'small' when e > 0 then 'unclear' else 'no' end verdict from a")
def verdicts(spark, d):
    a = rank.auc(lab(spark, d), "s", "y", None, ["g"]).withColumn("e", F.col("auc") - 0.5)
    return a.select("g", rs.verdict(F.col("e"), F.col("e") - 0.05, F.col("positives"), 0.05, 20).alias("verdict"))

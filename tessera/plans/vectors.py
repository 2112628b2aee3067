"""Vector queries on embeddings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as v
from ..functions.numbers import rounded
from ..operators import encode, layout, pairs, rank
from ..operators import vectors as ops
from ..operators.dictionary import numbered
from ..sources import tables as t
from ..sources.sinks import settled
from ..sources.tables import with_sql
from .registry import query

DOT = "list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2]))"
U = "e0 as (select vec_id id, label::bigint area, embedding::double[] e from embeddings), u as (select id, area, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) u from e0)"
PAIRS = f"p as (select a.id i, b.id j, a.area = b.area same, round(degrees(acos(greatest(-1, least(1, {DOT})))), 6) angle from u a join u b on a.id < b.id)"


def rows(spark, d):
    return ops.unit_rows(t.load(spark, d, "embeddings").withColumn("area", F.col("label").cast("long")), "vec_id", "embedding", "area")


BANDS = [0.0, 30.0, 45.0, 55.0, 65.0, 75.0, 85.0, 95.0, 180.0]
CASE = "case " + " ".join(f"when angle < {b} then '[{a:g},{b:g})'" for a, b in zip(BANDS, BANDS[1:], strict=False)) + " end"


@query("pair_angle_bands", f"with {U}, {PAIRS}, s as (select count(*) n, sum(same::int) k from p) select {CASE} band, count(*) pairs, sum(same::int)::bigint hits, round((sum(same::int) / count(*)::double) / (any_value(s.k) / any_value(s.n)::double), 6) lift from p, s group by 1")
def pair_angle_bands(spark, d):
    hist = ops.angle_histogram(rows(spark, d), "area", 5.0)
    low = F.col("bin") * 5.0
    name = F.lit(None).cast("string")
    for a, b in reversed(list(zip(BANDS, BANDS[1:], strict=False))):
        name = F.when(low < b, f"[{a:g},{b:g})").otherwise(name)
    x = hist.groupBy(name.alias("band")).agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("hits"))
    total = hist.agg((F.sum("same") / F.sum("pairs")).alias("base"))
    return x.crossJoin(F.broadcast(total)).select("band", "pairs", "hits", rounded(F.col("hits") / F.col("pairs") / F.col("base"), 6).alias("lift"))


AUC = """g as (select s, sum(case when y then w else 0 end) pw, sum(case when y then 0 else w end) nw from x group by s),
c as (select *, coalesce(sum(nw) over (order by s rows between unbounded preceding and 1 preceding), 0) below from g)"""
VALUE = "round(case when sum(pw) * sum(nw) > 0 then sum(pw * (below + 0.5 * nw)) / (sum(pw) * sum(nw)) end, 6)"


@query("angle_auc", f"with {U}, {PAIRS}, x as (select -angle s, same y, 1.0::double w from p), {AUC} select {VALUE} auc, sum(pw) positives, sum(nw) negatives from c")
def angle_auc(spark, d):
    out = ops.angle_auc(rows(spark, d), "area")
    return out.select(rounded("auc", 6).alias("auc"), "positives", "negatives")


@query("angle_histogram_auc", f"""with {U}, {PAIRS}, h as (select floor(angle / 0.5)::bigint bin, count(*) pairs, sum(same::int) same from p group by 1),
c as (select *, sum(pairs - same) over () n, coalesce(sum(pairs - same) over (order by bin rows between unbounded preceding and 1 preceding), 0) below from h) select round(sum(same * (n - below - 0.5 * (pairs - same))) / (sum(same) * sum(pairs - same)), 6) auc from c""")
def angle_histogram_auc(spark, d):
    return ops.histogram_auc(ops.angle_histogram(rows(spark, d), "area", 0.5)).select(rounded("auc", 6).alias("auc"))


@query("area_detector_auc", f"with {U}, {PAIRS}, x as (select same::int s, angle < 80 y, 1.0::double w from p), {AUC} select {VALUE} auc, sum(pw) positives, sum(nw) negatives from c")
def area_detector_auc(spark, d):
    h = ops.angle_histogram(rows(spark, d), "area", 5.0)
    y = F.col("bin") < 16
    x = h.select(F.lit(1).alias("s"), y.alias("y"), F.col("same").cast("double").alias("w")).union(h.select(F.lit(0), y, (F.col("pairs") - F.col("same")).cast("double")))
    return rank.auc(x.filter("w > 0"), "s", "y", "w").select(rounded("auc", 6).alias("auc"), "positives", "negatives")


@query("min_size_auc", f"with sz as (select source, lang, n_chars % 50 n, doc_id from documents), x as (select least(a.n, b.n) s, a.lang = b.lang y, 1.0::double w from sz a join sz b on a.source = b.source and a.doc_id < b.doc_id), {AUC} select {VALUE} auc, sum(pw) positives, sum(nw) negatives from c")
def min_size_auc(spark, d):
    s = t.load(spark, d, "documents").select("source", "lang", (F.col("n_chars") % 50).alias("n"), "doc_id")
    per = s.groupBy("source", "lang", "n").agg(F.count("*").alias("c"))
    a, b = per.toDF("source", "la", "na", "ca"), per.toDF("source", "lb", "nb", "cb")
    x = a.join(b, "source").withColumn("w", F.when((F.col("la") == F.col("lb")) & (F.col("na") == F.col("nb")), F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb") / 2))
    x = x.select(F.least("na", "nb").alias("s"), (F.col("la") == F.col("lb")).alias("y"), "w").filter("w > 0")
    return rank.auc(x, "s", "y", "w").select(rounded("auc", 6).alias("auc"), "positives", "negatives")


CENT = "m as (select area, pos, avg(x) m, count(*) n from (select area, unnest(u) x, generate_subscripts(u, 1) pos from u) group by 1, 2), cen as (select area, list(m order by pos) c, max(n) size from m group by 1), cu as (select area, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) c, size from cen)"


@query("label_centroids", f"with {U}, {CENT} select area, size, round(c[1], 6) c1, round(c[2], 6) c2, round(c[64], 6) c64 from cu")
def label_centroids(spark, d):
    c = ops.centroids(rows(spark, d), "area")
    return c.select("area", "size", *(rounded(F.element_at("c", k), 6).alias(f"c{k}") for k in (1, 2, 64)))


KNN = f"k as (select a.id query, b.id, b.area, round({DOT}, 9) sim, row_number() over (partition by a.id order by round({DOT}, 9) desc, b.id) rank from u a join u b on a.id <> b.id qualify rank <= 10)"


def _knn(spark, d, k=10):
    x = rows(spark, d)
    return ops.knn(x, x, k, ["area"])


@query("knn_top10", f"with {U}, {KNN} select query, id, rank, round(sim, 6) sim from k")
def knn_top10(spark, d):
    return _knn(spark, d).select("query", "id", "rank", rounded("sim", 6).alias("sim"))


@query("knn_query_corpus", f"with {U}, k as (select a.id query, b.id, round({DOT}, 9) sim, row_number() over (partition by a.id order by round({DOT}, 9) desc, b.id) rank from u a join u b on a.id % 10 = 0 and b.id % 10 <> 0 qualify rank <= 5) select query, id, rank, round(sim, 6) sim from k")
def knn_query_corpus(spark, d):
    x = rows(spark, d)
    return ops.knn(x.filter("id % 10 <> 0"), x.filter("id % 10 = 0"), 5).select("query", "id", "rank", rounded("sim", 6).alias("sim"))


@query("neighbour_mixing", f"with {U}, {KNN}, n as (select query, area, count(*) n, sum(sim) s from k group by 1, 2) select query, round(1 - max(n) / 10.0::double, 6) mixing, round(1 - sum(s) / 10.0::double, 6) sparsity from n group by 1")
def neighbour_mixing(spark, d):
    return ops.mixing(_knn(spark, d), "area", 10).select("query", rounded("mixing", 6).alias("mixing"), rounded("sparsity", 6).alias("sparsity"))


@query("knn_anomaly", f"with {U}, {KNN} select query, round(avg(1 - sim), 6) score from k group by 1")
def knn_anomaly(spark, d):
    return _knn(spark, d).groupBy("query").agg(rounded(F.avg(1 - F.col("sim")), 6).alias("score"))


@query("neighbourhood_kept", f"""with {U}, {KNN}, q as (select a.id query, b.id, row_number() over (partition by a.id order by round(list_sum(list_transform(range(1, 9), lambda i: a.u[i] * b.u[i])), 9) desc, b.id) rank from u a join u b on a.id <> b.id qualify rank <= 10)
select q.query, count(k.id) kept from q left join k on k.query = q.query and k.id = q.id group by 1""")
def neighbourhood_kept(spark, d):
    x = rows(spark, d)
    flat = x.withColumn("u", F.slice("u", 1, 8))
    low = ops.knn(flat, flat, 10).select("query", "id")
    full = ops.knn(x, x, 10).select("query", "id", F.lit(1).alias("hit"))
    return low.join(full, ["query", "id"], "left").groupBy("query").agg(F.count("hit").alias("kept"))


RAD = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


@query("betweenness_rank", f"""with {U}, ends as (select (select u from u where id = 0) a, (select u from u where id = 1) b),
g as (select id, acos(greatest(-1, least(1, {RAD.format("a", "u")}))) ac, acos(greatest(-1, least(1, {RAD.format("u", "b")}))) cb, acos(greatest(-1, least(1, {RAD.format("a", "b")}))) ab from u, ends where id > 1),
r as (select id, round((ac + cb) / ab, 6) detour from g) select id, detour, rank() over (order by detour) rank from r""")
def betweenness_rank(spark, d):
    x = rows(spark, d)
    ends = x.filter("id IN (0, 1)").agg(F.max_by("u", -F.col("id")).alias("a"), F.max_by("u", "id").alias("b"))
    arc = lambda p, q: F.acos(v.clip(v.dot(p, q)))
    x = x.filter("id > 1").crossJoin(F.broadcast(ends)).select("id", rounded((arc("a", "u") + arc("u", "b")) / arc("a", "b"), 6).alias("detour"))
    n = x.groupBy("detour").agg(F.count("*").cast("long").alias("n"))
    below = rank.cumulative(n, "detour", ["n"]).select("detour", (F.col("n_below") + 1).cast("long").alias("rank"))
    return x.join(below, "detour").select("id", "detour", "rank")


@query("topk_enrichment", f"with {U}, {PAIRS}, k as (select unnest([100, 1000, 10000]) k), r as (select same, row_number() over (order by angle, i, j) n from p), s as (select count(*) n, sum(same::int) y from p) select k.k::bigint k, sum(same::int)::bigint hits, round(sum(same::int) / k.k::double / (any_value(s.y) / any_value(s.n)::double), 6) lift from k join r on r.n <= k.k, s group by k.k")
def topk_enrichment(spark, d):
    import numpy as np
    import pandas as pd

    def fn(a, b, s):
        """The 10,000 smallest angles of each pair of blocks are enough for the smallest of all."""
        i, j = np.nonzero(~np.isnan(s))
        x = pd.DataFrame({"angle": np.round(np.degrees(np.arccos(s[i, j])), 6), "i": a["id"].to_numpy()[i], "j": b["id"].to_numpy()[j], "same": a["area"].to_numpy()[i] == b["area"].to_numpy()[j]})
        swap = x["i"] > x["j"]
        x.loc[swap, ["i", "j"]] = x.loc[swap, ["j", "i"]].to_numpy()
        return x.nsmallest(10_000, ["angle", "i", "j"])

    top = ops.block_pairs(rows(spark, d), fn, "angle double, i long, j long, same boolean", ["area"]).orderBy("angle", "i", "j").limit(10_000)
    top = top.withColumn("n", F.row_number().over(Window.orderBy("angle", "i", "j")))  # 10,000 rows at most
    base = ops.angle_histogram(rows(spark, d), "area", 5.0).agg((F.sum("same") / F.sum("pairs")).alias("base"))
    x = top.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in (100, 1000, 10_000))))).filter("n <= k")
    x = x.groupBy("k").agg(F.count_if("same").alias("hits")).crossJoin(F.broadcast(base))
    return x.select("k", "hits", rounded(F.col("hits") / F.col("k") / F.col("base"), 6).alias("lift"))


@query("radial_change", f"""with {U}, {CENT}, r as (select u.area, row_number() over (partition by u.area order by sqrt(2 - 2 * least(1, {RAD.format("u.u", "c.c")})), u.id) n, sqrt(2 - 2 * least(1, {RAD.format("u.u", "c.c")})) x from u join cu c on c.area = u.area),
h as (select area, n, x, lag(x) over (partition by area order by n) y from r) select area, round(avg(abs(x - y)), 6) + 0 step, round(max(x), 6) reach from h group by area""")
def radial_change(spark, d):
    x = rows(spark, d).join(ops.centroids(rows(spark, d), "area"), "area")
    r = F.sqrt(2 - 2 * F.least(F.lit(1.0), v.dot("u", "c")))
    w = Window.partitionBy("area").orderBy("x", "id")
    x = x.select("area", "id", r.alias("x")).withColumn("y", F.lag("x").over(w))
    return x.groupBy("area").agg((rounded(F.avg(F.abs(F.col("x") - F.col("y"))), 6) + F.lit(0.0)).alias("step"), rounded(F.max("x"), 6).alias("reach"))


@query("shuffled_control_auc", f"""with {U}, o as (select id, area, row_number() over (order by sha256('shuffle:' || id)) n from u), r as (select id, row_number() over (order by id) n from u),
sh as (select r.id, o.area from r join o using (n)), p as (select a.id i, b.id j, x.area = y.area same, round(degrees(acos(greatest(-1, least(1, {DOT})))), 6) angle from u a join u b on a.id < b.id join sh x on x.id = a.id join sh y on y.id = b.id),
x as (select -angle s, same y, 1.0::double w from p), {AUC} select {VALUE} auc from c""")
def shuffled_control_auc(spark, d):
    x = rows(spark, d)
    a = numbered(x.select("id"), ["id"], "n")
    b = x.select("area", F.sha2(F.concat(F.lit("shuffle:"), F.col("id").cast("string")), 256).alias("h"))
    s = settled(x.drop("area").join(a.join(numbered(b, ["h"], "n").select("area", "n"), "n").select("id", "area"), "id"))
    return ops.angle_auc(s, "area").select(rounded("auc", 6).alias("auc"))


@query("sphere_fidelity", None)
def sphere_fidelity(spark, d):
    """What three axes keep of the vectors, and where they lie on the sphere."""
    return layout.sphere(rows(spark, d)).select("id", *(rounded(c, 6).alias(c) for c in ("x", "y", "z", "fidelity")))


@query("sphere_layout", None)
def sphere_layout(spark, d, epochs: int = 6):
    """The projection after a few rounds of pulling ten neighbours together."""
    x = rows(spark, d)
    return layout.layout(layout.sphere(x).filter("x IS NOT NULL"), _knn(spark, d).select("query", "id"), 10, epochs, rate=0.25, repel=0.1)


def _between(a, b):
    """The direction halfway between two vectors; of opposite ones, the first."""
    import numpy as np

    m = a + b
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 1e-12, m / np.maximum(n, 1e-12), a)


@query("rerank_novel", with_sql("paper", "cit") + f""", {U}, co as (select a.work i, b.work j, count(*)::double score from cit a join cit b on a.paper = b.paper and a.work < b.work where a.work in (select id from u) and b.work in (select id from u) group by 1, 2 order by score desc, i, j limit 2000),
pm as (select i, j, score, a.u ui, b.u uj, list_transform(list_zip(a.u, b.u), lambda z: z[1] + z[2]) m from co join u a on a.id = i join u b on b.id = j), pu as (select *, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) p from pm),
nv as (select i, j, 1 - max(round(list_sum(list_transform(list_zip(p, b.u), lambda z: z[1] * z[2])), 9)) novelty from pu join u b on b.id <> i and b.id <> j group by 1, 2),
x as (select i, j, score, round(novelty, 9) novelty, round(1 - greatest(list_sum(list_transform(list_zip(p, ui), lambda z: z[1] * z[2])), list_sum(list_transform(list_zip(p, uj), lambda z: z[1] * z[2]))), 9) reach from pu join nv using (i, j)),
r as (select *, {" + ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double" for c in ("score", "novelty", "reach"))} total from x)
select i, j, score, round(novelty, 6) novelty, round(reach, 6) reach, round(total / 3, 1) novel from r""")
def rerank_novel(spark, d):
    """The 2,000 pairs of works most often cited together, ranked again by how new what lies between them is."""
    x = rows(spark, d).select("id", "u")
    ids = x.select("id")
    cit = t.citations(spark, d).join(ids.toDF("work"), "work", "left_semi")
    co = pairs.co_cited(cit.select(F.col("paper").alias("list"), F.col("work").alias("item"))).select("i", "j", F.col("n").cast("double").alias("score"))
    return encode.reranked(co, x, _between, 2000).select("i", "j", "score", rounded("novelty", 6).alias("novelty"), rounded("reach", 6).alias("reach"), rounded("novel", 1).alias("novel"))

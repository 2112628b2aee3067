"""State, registry and lookup queries on conversations and documents, and the learned and greedy ones (no SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import certify, greedy, grid, models, pairs, rank
from ..sources import tables as t
from ..sources.sinks import settled
from . import grid as g
from .registry import query


def states(spark, d):
    return t.load(spark, d, "conversations")


@query("state_ordinals", "select conv_id, turn, row_number() over (partition by conv_id order by turn, role) - 1 place from conversations")
def state_ordinals(spark, d):
    return certify.ordinals(states(spark, d), "conv_id", "turn", "role").select("conv_id", "turn", "place")


@query("completeness", "select conv_id, count(*) records, count(*) filter (where length(text) > 60) vectors, count(*) - count(*) filter (where length(text) > 60) missing, count(*) = count(*) filter (where length(text) > 60) complete from conversations group by conv_id")
def completeness(spark, d):
    s = states(spark, d).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return certify.completeness(s, s.filter(F.length("text") > 60), "conv_id", "key")


CLASSES = "cls as (select doc_id id, min(doc_id) over (partition by sha256(text)) rep from documents)"


def _pairs(spark, d):
    """Equal texts as pairs (a <= b) with the reflexive ones."""
    docs = t.load(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2("text", 256).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("rep"))
    x = docs.join(least, "h").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(True).alias("same"))
    return docs.select(F.col("doc_id").alias("id")), x


@query("registry_classes", f"with {CLASSES} select id, rep from cls")
def registry_classes(spark, d):
    ids, p = _pairs(spark, d)
    return certify.registry(ids, p)


@query("relation_faults", """with o as (select o_orderkey k, o_custkey c, year(o_orderdate) y from orders), p as (select a.k a, b.k b from o a join o b on a.c = b.c and a.k <= b.k and abs(a.y - b.y) <= 1),
ls as (select k, min(m) rep from (select a k, b m from p union all select b, a from p) group by k), sp as (select count(*) n from p join ls x on x.k = a join ls y on y.k = b where x.rep <> y.rep),
m as (select x.rep, count(*) m from p join ls x on x.k = a group by 1), n as (select rep, count(*) n from ls group by 1), fu as (select count(*) n from m join n using (rep) where m <> n * (n + 1) // 2)
select 'transitive' fault, sp.n + fu.n n from sp, fu""")
def relation_faults(spark, d):
    """Is `of one customer, at most a year apart` an equivalence of orders? Each class is held against its number of pairs; pairs outside of classes are never made."""
    o = t.load(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"))
    p = o.toDF("a", "c", "ya").join(o.toDF("b", "c", "yb"), "c").filter("a <= b AND abs(ya - yb) <= 1").select("a", "b", F.lit(True).alias("same"))
    return certify.relation_faults(o.select("id"), p, complete=False).groupBy("fault").agg(F.count("*").alias("n"))


@query("payload_faults", "with x as (select source, lang, n_chars from documents) select lang payload, count(distinct source) classes from x group by lang having count(distinct source) > 1")
def payload_faults(spark, d):
    x = t.load(spark, d, "documents")
    return certify.payload_faults(x.select(F.col("doc_id").alias("id"), F.col("source").alias("rep")), x.select(F.col("doc_id").alias("id"), F.col("lang").alias("payload")))


@query("vector_checks", "with e as (select vec_id id, list_transform(embedding, lambda x: x::double) v from embeddings) select id, abs(sqrt(list_sum(list_transform(v, lambda x: x * x))) - 1) <= 1e-6::double as unit, true finite from e")
def vector_checks(spark, d):
    return certify.vector_checks(t.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


UNITS = "u0 as (select vec_id id, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) v from embeddings), u1 as (select id, list_transform(v, lambda x: round(x, 9)) w from u0)"


@query("vector_faults", f"""with {UNITS}, dr as (select id, sqrt(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) d from u0 join u1 using (id)),
cl as (select a.id a, b.id b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) d from u0 a join u0 b on a.id < b.id),
tk as (select text, min(doc_id) a from documents join u0 on id = doc_id where text is not null group by text having count(*) > 1)
select 'drift' fault, id a, null::bigint b from dr where d > 1e-6::double union all select 'collapse', a, b from cl where d <= 1e-6::double union all select 'nonunit', id, null from u1 where abs(sqrt(list_sum(list_transform(w, lambda y: y * y))) - 1) > 1e-7::double
union all select 'tokens', a, doc_id from tk join documents using (text) where doc_id <> a and doc_id in (select id from u0)""")
def vector_faults(spark, d):
    """The vectors against a repeat of nine decimals; the texts of their numbers are the tokens."""
    from ..functions import vector as v

    e = t.load(spark, d, "embeddings")
    x = e.select(F.col("vec_id").alias("id"), v.unit("embedding").alias("v"))
    again = x.select("id", F.transform("v", lambda c: F.round(c, 9)).alias("v"))
    texts = t.load(spark, d, "documents", ["doc_id", "text"]).join(x.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return certify.vector_faults(x, again, texts.toDF("id", "tokens"), length=1e-7).select("fault", "a", "b")


@query("fail_closed_lookup", "select l.doc_id, l.quality, d.lang from labels l join documents d using (doc_id)")
def fail_closed_lookup(spark, d):
    return certify.lookup(t.load(spark, d, "labels"), t.load(spark, d, "documents", ["doc_id", "lang"]), "doc_id").select("doc_id", "quality", "lang")


@query("text_union", "with a as (select distinct text from documents where source in ('src0', 'src1')), b as (select distinct text from documents where source in ('src1', 'src2')) select (select count(*) from (select * from a union select * from b)) both_, (select count(*) from (select * from a intersect select * from b)) common, (select count(*) from (select * from a except select * from b)) only_a")
def text_union(spark, d):
    x = t.load(spark, d, "documents", ["text", "source"])
    a, b = (x.filter(F.col("source").isin(*s)).select(F.sha2("text", 256).alias("h")).distinct() for s in (("src0", "src1"), ("src1", "src2")))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.union(b).distinct(), "both_").crossJoin(n(a.intersect(b), "common")).crossJoin(n(a.subtract(b), "only_a"))


@query("priority_dedupe", "select text_hash, source, doc_id from (select sha256(text) text_hash, source, doc_id, row_number() over (partition by sha256(text) order by source, doc_id) n from documents) where n = 1")
def priority_dedupe(spark, d):
    """The first source wins: an aggregate, not a window, so a text that many rows hold is one partial result per task."""
    x = t.load(spark, d, "documents", ["doc_id", "text", "source"])
    first = x.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min(F.struct("source", "doc_id")).alias("f"))
    return first.select("text_hash", "f.source", "f.doc_id")


@query("generated_names", r"select count(*) filter (where not regexp_matches(p_name || '.' || p_brand, '\.proof_\d+$')) kept, count(*) filter (where regexp_matches(p_type, 'BRASS|STEEL|TIN')) auto from part")
def generated_names(spark, d):
    p = t.load(spark, d, "part")
    name = F.concat_ws(".", "p_name", "p_brand")
    return p.agg(F.count_if(~name.rlike(r"\.proof_\d+$")).alias("kept"), F.count_if(F.col("p_type").rlike("BRASS|STEEL|TIN")).alias("auto"))


@query("fits_in_bytes", "select source, count(*) texts, count(*) filter (where strlen(text) <= 8192) fits, bool_or(strlen(text) <= 8192) kept from documents group by source")
def fits_in_bytes(spark, d):
    fits = F.octet_length("text") <= 8192
    return t.load(spark, d, "documents", ["source", "text"]).groupBy("source").agg(F.count("*").alias("texts"), F.count_if(fits).alias("fits"), F.bool_or(fits).alias("kept"))


@query("pair_flags", "with f as (select doc_id, (toxic | (quality << 1) | ((doc_id % 2) << 2))::bigint flags from labels) select flags, count(*) n, count(*) filter (where flags & 1 = 1) pos, count(*) filter (where (flags >> 1) & 1 = 1) gen from f group by flags")
def pair_flags(spark, d):
    f = F.col("toxic").cast("long").bitwiseOR(F.shiftleft(F.col("quality").cast("long"), 1)).bitwiseOR(F.shiftleft((F.col("doc_id") % 2).cast("long"), 2))
    x = t.load(spark, d, "labels").select(f.alias("flags"))
    return x.groupBy("flags").agg(F.count("*").alias("n"), F.count_if(F.col("flags").bitwiseAND(1) == 1).alias("pos"), F.count_if(F.shiftright("flags", 1).bitwiseAND(1) == 1).alias("gen"))


@query("module_area", "select case when contains(s, '.') then split_part(s, '.', 2) else '' end area, count(*) n from (select case when doc_id % 3 = 0 then source else lang || '.' || source || '.x' end s from documents) group by 1")
def module_area(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat_ws(".", "lang", "source", F.lit("x")))
    return t.load(spark, d, "documents", ["doc_id", "source", "lang"]).groupBy(tx.second_part(s).alias("area")).agg(F.count("*").alias("n"))


@query("pilot_arms", "with p as (select lang arm, source pair, bool_or(toxic = 1) hit, count(*) checks, max(quality) best from labels join documents using (doc_id) group by 1, 2) select arm, sum(checks)::bigint checks, sum(hit::int)::bigint hits, sum(best)::bigint rated from p group by arm")
def pilot_arms(spark, d):
    x = t.load(spark, d, "labels").join(t.load(spark, d, "documents", ["doc_id", "lang", "source"]), "doc_id")
    p = x.groupBy(F.col("lang").alias("arm"), "source").agg(F.bool_or(F.col("toxic") == 1).alias("hit"), F.count("*").alias("checks"), F.max("quality").alias("best"))
    return p.groupBy("arm").agg(F.sum("checks").alias("checks"), F.count_if("hit").alias("hits"), F.sum("best").cast("long").alias("rated"))


@query("judged_use", "with c as (select conv_id, bool_or(role = 'assistant' and length(text) > 80) and bool_or(role = 'user') used from conversations group by conv_id) select used, count(*) cells from c group by used")
def judged_use(spark, d):
    c = states(spark, d).groupBy("conv_id").agg((F.bool_or((F.col("role") == "assistant") & (F.length("text") > 80)) & F.bool_or(F.col("role") == "user")).alias("used"))
    return c.groupBy("used").agg(F.count("*").alias("cells"))


@query("length_batches", None)
def length_batches(spark, d):
    """Batches of documents by length: at most 64 of them, and 32,768 characters with padding."""
    return greedy.batches(t.load(spark, d, "documents", ["doc_id", "n_chars"]), "doc_id", "n_chars", 64, 32_768)


@query("greedy_matching", None)
def greedy_matching(spark, d):
    from .texts import _new_pairs

    return greedy.matching(_new_pairs(spark, d).select(F.col("i").alias("u"), F.col("j").alias("v")))


@query("greedy_arm_fill", None)
def greedy_arm_fill(spark, d):
    c = pairs.co_cited(t.citations(spark, d).select(F.col("paper").alias("list"), F.col("work").alias("item")))
    x = c.select(F.when(F.col("i") % 2 == 0, "even").otherwise("odd").alias("arm"), F.col("i").alias("u"), F.col("j").alias("v"), F.col("n").cast("double").alias("score"))
    return greedy.fill(x, ["even", "odd"], 25)


def _features(spark, d, cit=None):
    cit = settled(t.citations(spark, d)) if cit is None else cit
    x = g.labelled(spark, d, cit)
    f = grid.work_features(cit, g.CUT, g.RECENT, g.CITES)
    flow = grid.flows(cit, t.work_areas(spark, d), g.CUT, g.RECENT)
    return x.join(f, "work").join(flow, ["work", "area"], "left").fillna(0.0, ["flow"])


@query("oof_logistic_auc", None)
def oof_logistic_auc(spark, d):
    """AUC of out-of-fold scores, folds by work, with and without the flow."""
    x = settled(_features(spark, d))  # every fit reads it several times
    base = ["cites", "recent", "reach"]
    a = rank.auc(models.out_of_fold(x, base, "pos", "work"), "score", "pos").select(F.lit("base").alias("model"), "auc")
    return a.union(rank.auc(models.out_of_fold(x, [*base, "flow"], "pos", "work"), "score", "pos").select(F.lit("base+flow"), "auc"))


@query("train_forward_lists", None)
def train_forward_lists(spark, d):
    """Trained at one cutoff, applied at the next: the 10 best empty cells of each area."""
    cit = settled(t.citations(spark, d))
    names = ["cites", "recent", "reach", "flow"]
    x = settled(_features(spark, d, cit).select(*names, "pos"))  # the fit reads it several times
    model, how = models.logistic(x, names, "pos")
    later = grid.empty_cells(cit, t.areas(spark, d), g.CUT + 2, g.CITES, t.work_areas(spark, d))
    f = grid.work_features(cit, g.CUT + 2, g.RECENT, g.CITES)
    flow = grid.flows(cit, t.work_areas(spark, d), g.CUT + 2, g.RECENT)
    later = later.join(f, "work").join(flow, ["work", "area"], "left").fillna(0.0, ["flow"])
    return rank.top_per(models.score(later, model, how), "area", "score", ["work"], 10).select("area", "work", "rank", "score")


@query("poisson_slope", None)
def poisson_slope(spark, d):
    """Outcome papers by surprise, size and their product."""
    x = _features(spark, d).join(g._spans(spark, d), ["work", "area"])
    how = models.moments(x, ["bits", "cites"])
    z = x.select("outcome", *(((F.col(k) - m) / F.lit(s or 1.0)).alias(k) for k, (m, s) in how.items())).withColumn("both", F.col("bits") * F.col("cites"))
    return spark.createDataFrame(sorted(models.poisson(z, ["bits", "cites", "both"], "outcome").items()), "term string, coefficient double")


@query("regression_bootstrap", None)
def regression_bootstrap(spark, d, draws: int = 40):
    """The slopes of poisson_slope with one-hot areas, refitted on draws of the works: mean and spread over the draws."""
    x = _features(spark, d).join(g._spans(spark, d), ["work", "area"])
    how = models.moments(x, ["bits", "cites"])
    z = x.select("work", "area", "outcome", *(((F.col(k) - m) / F.lit(s or 1.0)).alias(k) for k, (m, s) in how.items())).withColumn("both", F.col("bits") * F.col("cites"))
    z, areas = models.one_hot(z, "area", t.AREAS)
    got = models.poisson_draws(z, ["bits", "cites", "both", *areas], "outcome", "work", draws, "regression")
    return got.groupBy("term").agg(F.count("*").alias("draws"), F.avg("coefficient").alias("mean"), F.stddev_pop("coefficient").alias("sd"), F.min("coefficient").alias("low"), F.max("coefficient").alias("high"))


@query("svd_similarity", None)
def svd_similarity(spark, d):
    """Cosines of language profiles on the leading directions of hashed TF-IDF rows."""
    docs = t.load(spark, d, "documents", ["doc_id", "text", "lang"])
    w = tx.tfidf(tx.counts(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")))
    x = settled(w.groupBy("item", F.pmod(F.xxhash64("key"), F.lit(512)).cast("int").alias("col")).agg(F.sum("w").alias("w")))
    v = models.svd(x, "item", "col", "w", 8).join(docs.select(F.col("doc_id").alias("item"), "lang"), "item")
    m = v.select("lang", F.posexplode("v").alias("p", "x")).groupBy("lang", "p").agg(F.avg("x").alias("x"))
    a, b = m.toDF("a", "p", "xa"), m.toDF("b", "p", "xb")
    n = m.groupBy("lang").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    s = a.join(b, "p").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("s"))
    s = s.join(F.broadcast(n.toDF("a", "na")), "a").join(F.broadcast(n.toDF("b", "nb")), "b")
    return s.select("a", "b", F.round(F.col("s") / (F.col("na") * F.col("nb")), 4).alias("cos"))


@query("hull_relation", None)
def hull_relation(spark, d):
    """Hulls of the vectors of neighbouring labels in their first three dimensions."""
    e = t.load(spark, d, "embeddings").select(F.col("label").cast("long").alias("object"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    p = e.select(F.col("object").alias("left")).distinct().withColumn("right", (F.col("left") + 1) % 10).filter("left <> right")
    return certify.hull_relations(p, e)


@query("jump_triplets", None)
def jump_triplets(spark, d):
    """Anchor: a paper of an area new to the work; positive: an earlier citer; negative: a citer of another work from the positive's area. Hash order picks."""
    cit = settled(t.citations(spark, d))  # seven steps read them
    first = grid.arrivals(cit, 5, 3)
    h = lambda *c: F.sha2(F.concat_ws("|", *(F.col(x).cast("string") for x in c)), 256)
    jump = first.join(cit.withColumnRenamed("year", "y"), ["work", "area"]).filter("y = year").select("work", "area", "year", F.col("paper").alias("anchor"))
    early = cit.select("work", F.col("paper").alias("positive"), F.col("year").alias("py"), F.col("area").alias("home"))
    x = jump.join(early, "work").filter("py < year").groupBy("work", "area", "anchor").agg(F.min_by(F.struct("positive", "home"), h("anchor", "positive")).alias("p"))
    x = settled(x.select("work", "area", "anchor", "p.positive", "p.home"))
    return grid.negatives(x, cit).select("work", "area", "anchor", "positive", "negative")

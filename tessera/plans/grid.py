"""Grid and forecast queries on the citation-shaped tables, each with its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import grid, rank
from ..sources import tables as t
from ..sources.tables import with_sql
from .registry import query

CUT, FIRST, LAST, RECENT, CITES, POS = 1997, 1998, 2001, 2, 5, 2


def cells(spark, d, cit=None):
    return grid.empty_cells(t.citations(spark, d) if cit is None else cit, t.areas(spark, d), CUT, CITES, t.work_areas(spark, d))


HIST = f"hist as (select * from cit where year <= {CUT})"
TOOL = f"tool as (select work from hist group by work having count(*) >= {CITES})"
CELL = "cell as (select tool.work, areas.area from tool cross join areas where not exists (select 1 from hist h where h.work = tool.work and h.area = areas.area) and not exists (select 1 from home where home.work = tool.work and home.home = areas.area))"
OUT = f"outc as (select work, area, count(*) n from cit where year between {FIRST} and {LAST} group by 1, 2)"
LABELLED = f"cells as (select c.work, c.area, coalesce(o.n, 0) outcome, coalesce(o.n, 0) >= {POS} pos from cell c left join outc o on o.work = c.work and o.area = c.area)"
BASE = with_sql("paper", "cit", "home", "areas") + f",\n{HIST},\n{TOOL},\n{CELL},\n{OUT},\n{LABELLED}"
FLOW = f"""share as (select work, area b, count(*)::double / sum(count(*)) over (partition by work) share from hist group by work, area),
sent as (select h.area, home.home b, count(*)::double / sum(count(*)) over (partition by h.area) w from hist h join home on h.work = home.work where h.year > {CUT - RECENT} group by h.area, home.home),
flow as (select share.work, sent.area, sum(share * w) flow from share join sent using (b) group by 1, 2)"""
XLIST = "xl as (select h.work, s.area2 area, count(*) n from hist h join sec s on s.paper = h.paper group by 1, 2)"
SHARED = f"""shared as (select distinct m.work, o.area from (select distinct h.work, a.author from hist h join author a on a.paper = h.paper) m
  join (select distinct a.author, p.area from paper p join author a on a.paper = p.paper where p.year <= {CUT}) o on o.author = m.author)"""
SECOND = f"second as (select distinct h.work, o.area from hist h join (select distinct r.cited, p.area from paper p join ref r on r.paper = p.paper where p.year <= {CUT}) o on o.cited = h.paper)"
LADDER_BASE = with_sql("paper", "cit", "author", "sec", "ref", "home", "areas") + f",\n{HIST},\n{TOOL},\n{CELL},\n{OUT},\n{LABELLED},\n{FLOW},\n{XLIST},\n{SHARED},\n{SECOND}"
COC = """used as (select distinct work, area from hist),
pairs as (select x.area a, y.area b, count(*) n from used x join used y on x.work = y.work group by 1, 2),
f as (select p.a, p.b, p.n::double / o.n f from pairs p join pairs o on o.a = p.b and o.b = p.b)"""


def labelled(spark, d, cit=None):
    return grid.outcomes(cells(spark, d, cit), t.citations(spark, d) if cit is None else cit, FIRST, LAST, POS)


@query("grid_cells", f"{BASE} select work, area, outcome, pos from cells")
def grid_cells(spark, d):
    return labelled(spark, d)


@query("tool_features", with_sql("paper", "cit") + f""", {HIST} select work, round(ln(1 + count(*)), 6) cites, round(ln(1 + sum((year > {CUT - RECENT})::int)), 6) recent, count(distinct area) reach
from hist group by work having count(*) >= {CITES}""")
def tool_features(spark, d):
    return grid.work_features(t.citations(spark, d), CUT, RECENT, CITES).select("work", rounded("cites", 6).alias("cites"), rounded("recent", 6).alias("recent"), "reach")


@query("area_size", with_sql("paper") + f" select area, round(ln(1 + count(*)), 6) size from paper where year between {CUT - RECENT + 1} and {CUT} group by area")
def area_size(spark, d):
    return t.papers(spark, d).filter(F.col("year").between(CUT - RECENT + 1, CUT)).groupBy("area").agg(rounded(F.log1p(F.count("*")), 6).alias("size"))


@query("flow", with_sql("paper", "cit", "home") + f", {HIST}, {FLOW} select work, area, round(flow, 6) flow from flow")
def flow(spark, d):
    return grid.flows(t.citations(spark, d), t.work_areas(spark, d), CUT, RECENT).withColumn("flow", rounded("flow", 6))


@query("xlist", with_sql("paper", "cit", "author", "sec") + f", {HIST}, {XLIST} select work, area, n xlist from xl")
def xlist(spark, d):
    return grid.cross_listed(t.citations(spark, d), t.secondary(spark, d), CUT)


def _rungs(spark, d):
    cit, papers = t.citations(spark, d), t.papers(spark, d)
    return (
        grid.cross_listed(cit, t.secondary(spark, d), CUT),
        grid.shared_authors(cit, papers, t.authors(spark, d), CUT),
        grid.second_hand(cit, papers, t.references(spark, d), CUT),
        grid.flows(cit, t.work_areas(spark, d), CUT, RECENT).withColumn("flow", rounded("flow", 9)),
    )


RUNG = """lad as (select c.*, coalesce(round(fl.flow, 9), 0) flow, case when x.work is not null then 1 when s.work is not null then 2 when n.work is not null then 3 end low
  from cells c left join xl x on x.work = c.work and x.area = c.area left join shared s on s.work = c.work and s.area = c.area
  left join second n on n.work = c.work and n.area = c.area left join flow fl on fl.work = c.work and fl.area = c.area),
rungs as (select work, area, outcome, pos, coalesce(low, case when flow >= (select quantile_cont(flow, 0.75) from lad) then 4 else 5 end)::bigint rung from lad)"""


@query("closeness_ladder", f"{LADDER_BASE}, {RUNG} select work, area, pos, rung from rungs")
def closeness_ladder(spark, d):
    return grid.ladder(labelled(spark, d), *_rungs(spark, d)).select("work", "area", "pos", "rung")


@query("rung_rates", f"{LADDER_BASE}, {RUNG} select rung, count(*) cells, sum(pos::int)::bigint jumps, sum((outcome >= 5)::int)::bigint took_hold, round(avg(pos::int), 6) rate from rungs group by rung")
def rung_rates(spark, d):
    x = grid.ladder(labelled(spark, d), *_rungs(spark, d))
    return x.groupBy("rung").agg(
        F.count("*").alias("cells"), F.count_if("pos").alias("jumps"), F.count_if(F.col("outcome") >= 5).alias("took_hold"), rounded(F.avg(F.col("pos").cast("int")), 6).alias("rate")
    )


SIX = """near as (select distinct m.work, a.area from (select distinct h.work, areas.parent from hist h join areas on areas.area = h.area) m join areas a on a.parent = m.parent),
lad6 as (select c.*, coalesce(round(fl.flow, 9), 0) flow, case when x.work is not null then 1 when s.work is not null then 2 when n.work is not null then 3 when r.work is not null then 4 end low
  from cells c left join xl x on x.work = c.work and x.area = c.area left join shared s on s.work = c.work and s.area = c.area left join second n on n.work = c.work and n.area = c.area
  left join near r on r.work = c.work and r.area = c.area left join flow fl on fl.work = c.work and fl.area = c.area)"""


@query("six_rung_ladder", f"{LADDER_BASE}, {SIX} select work, area, coalesce(low, case when flow > 0 and flow >= (select quantile_cont(flow, 0.75) from lad6 where flow > 0) then 5 else 6 end)::bigint rung from lad6")
def six_rung_ladder(spark, d):
    return grid.six_rungs(labelled(spark, d), t.citations(spark, d), t.areas(spark, d), *_rungs(spark, d), CUT).select("work", "area", "rung")


@query("cocitation_share", with_sql("paper", "cit") + f", {HIST}, {COC} select a, b, round(f, 6) f from f")
def cocitation_share(spark, d):
    return grid.cocitation(grid.history(t.citations(spark, d), CUT)).withColumn("f", rounded("f", 6))


SPAN = """mix as (select work, area b, count(*)::double / sum(count(*)) over (partition by work) s from hist group by 1, 2),
known as (select m.work, f.a area, sum(m.s * f.f) p from mix m join f on f.b = m.b group by 1, 2),
span as (select w.work, areas.area, -log2(greatest(coalesce(k.p, 0), 1e-12)) bits from (select distinct work from hist) w cross join areas left join known k on k.work = w.work and k.area = areas.area)"""


def _spans(spark, d):
    h = grid.history(t.citations(spark, d), CUT)
    return grid.spans(h, grid.cocitation(h), t.areas(spark, d))


@query("span_bits", with_sql("paper", "cit", "areas") + f", {HIST}, {COC}, {SPAN} select work, area, round(bits, 6) + 0 bits from span")
def span_bits(spark, d):
    return _spans(spark, d).withColumn("bits", rounded("bits", 6) + F.lit(0.0))


ARRIVE = """first as (select work, area, min(year) y0 from cit group by 1, 2),
arr as (select f.work, f.area, f.y0 as year, count(*) filter (where c.year < f.y0) prior, count(*) filter (where c.area = f.area and c.year = f.y0) arriving,
  count(*) filter (where c.area = f.area and c.year > f.y0 and c.year <= f.y0 + 3) follow_on from first f join cit c on c.work = f.work group by f.work, f.area, f.y0 having count(*) filter (where c.year < f.y0) >= 5)"""


@query("arrival_cells", with_sql("paper", "cit") + f", {ARRIVE} select * from arr")
def arrival_cells(spark, d):
    return grid.arrivals(t.citations(spark, d), 5, 3)


@query("follow_on", with_sql("paper", "cit") + f""", {ARRIVE}, lags as (select c.year - a.year lag, count(*) n from arr a join cit c on c.work = a.work and c.area = a.area where c.year - a.year between 1 and 3 group by 1)
select lag, n, sum(n) over (order by lag)::bigint total from lags""")
def follow_on(spark, d):
    cit = t.citations(spark, d)
    return grid.follow_on(cit, grid.arrivals(cit, 5, 3), 3)


HOMES = "homes as (select work, arg_max(area, n * 1000 - area) home, count(*) breadth from (select work, area, count(*) n from hist group by 1, 2) group by work)"


@query("home_breadth", with_sql("paper", "cit") + f", {HIST}, {HOMES} select * from homes")
def home_breadth(spark, d):
    return grid.home_breadth(grid.history(t.citations(spark, d), CUT))


NEAR = "near3 as (select a, b, row_number() over (partition by a order by f desc, b) rank from f where a <> b qualify rank <= 3)"


@query("nearest_areas", with_sql("paper", "cit") + f", {HIST}, {COC}, {NEAR} select a, b, rank from near3")
def nearest_areas(spark, d):
    return grid.nearest(grid.cocitation(grid.history(t.citations(spark, d), CUT))).select("a", "b", "rank")


DOOR = """lab as (select c.*, case when exists (select 1 from xl where xl.work = c.work and xl.area = c.area) then 'knocking'
  when exists (select 1 from hist h join near3 n on n.b = h.area where h.work = c.work and n.a = c.area) then 'next door' else 'surprising' end as label from cells c)"""


def _labels(spark, d):
    cit = t.citations(spark, d)
    x = grid.cross_listed(cit, t.secondary(spark, d), CUT)
    return grid.surprise(labelled(spark, d), cit, x, grid.cocitation(grid.history(cit, CUT)), CUT)


LABEL_BASE = with_sql("paper", "cit", "author", "sec", "home", "areas") + f", {HIST}, {TOOL}, {CELL}, {OUT}, {LABELLED}, {XLIST}, {COC}, {NEAR}, {DOOR}"


@query("surprise_label", f"{LABEL_BASE} select label, count(*) cells, sum(pos::int)::bigint jumps from lab group by label")
def surprise_label(spark, d):
    return _labels(spark, d).groupBy("label").agg(F.count("*").alias("cells"), F.count_if("pos").alias("jumps"))


GRID_STEPS = "steps as (select unnest([0.25, 0.5, 0.75, 1.0])::double bits0)"


@query("threshold_grid", f"{LABEL_BASE}, {SPAN}, {GRID_STEPS} select bits0, label, count(*) pairs, sum((outcome >= 1)::int)::bigint crossed, sum(pos::int)::bigint jumps from lab join (select work, area, round(bits, 6) bits from span) s using (work, area) join steps on s.bits >= bits0 group by 1, 2")
def threshold_grid(spark, d):
    x = _labels(spark, d).join(_spans(spark, d).withColumn("bits", rounded("bits", 6)), ["work", "area"])
    steps = [0.25, 0.5, 0.75, 1.0]
    x = x.withColumn("bits0", F.explode(F.filter(F.array(*map(F.lit, steps)), lambda e: e <= F.col("bits"))))
    return x.groupBy("bits0", "label").agg(F.count("*").alias("pairs"), F.count_if(F.col("outcome") >= 1).alias("crossed"), F.count_if("pos").alias("jumps"))


@query("horizon_sweep", with_sql("paper", "cit") + """, cuts as (select unnest([1996, 1997, 1998]) cut), watch as (select unnest([1, 2, 3]) w),
have as (select distinct cut, work, area from cit join cuts on year <= cut), fresh as (select cuts.cut, watch.w, c.work, c.area, count(*) n from cit c join cuts on c.year > cut join watch on c.year <= cut + w group by all)
select f.cut::bigint cut, f.w::bigint w, count(*) arrivals, sum((n >= 2)::int)::bigint jumps from fresh f where not exists (select 1 from have h where h.cut = f.cut and h.work = f.work and h.area = f.area) group by 1, 2""")
def horizon_sweep(spark, d):
    cit = t.citations(spark, d).groupBy("work", "area", "year").agg(F.count("*").alias("n"))
    cuts = cit.withColumn("cut", F.explode(F.array(*(F.lit(c).cast("long") for c in (1996, 1997, 1998)))))
    have = cuts.filter("year <= cut").select("cut", "work", "area").distinct()
    late = cuts.filter("year > cut").withColumn("w", F.explode(F.array(*(F.lit(w).cast("long") for w in (1, 2, 3))))).filter("year <= cut + w")
    fresh = late.groupBy("cut", "w", "work", "area").agg(F.sum("n").alias("n")).join(have, ["cut", "work", "area"], "left_anti")
    return fresh.groupBy("cut", "w").agg(F.count("*").alias("arrivals"), F.count_if(F.col("n") >= 2).alias("jumps"))


@query("grain_sweep", with_sql("paper", "cit", "areas") + f""", g as (select 'area' grain, work, area::bigint cell from cit where year <= {CUT} union all select 'parent', c.work, a.parent from cit c join areas a using (area) where c.year <= {CUT})
select grain, count(distinct work) works, count(distinct (work, cell)) filled, count(*) citations from g group by grain""")
def grain_sweep(spark, d):
    h = grid.history(t.citations(spark, d), CUT)
    both = h.select(F.lit("area").alias("grain"), "work", F.col("area").alias("cell"))
    both = both.union(h.join(F.broadcast(t.areas(spark, d)), "area").select(F.lit("parent").alias("grain"), "work", F.col("parent").alias("cell")))
    n = both.groupBy("grain", "work", "cell").agg(F.count("*").alias("n"))
    return n.groupBy("grain").agg(F.countDistinct("work").alias("works"), F.count("*").alias("filled"), F.sum("n").alias("citations"))


@query("textbook_filter", with_sql("paper", "cit") + f", {HIST}, {HOMES} select work, breadth from homes where breadth >= (select quantile_cont(breadth, 0.9) from homes)")
def textbook_filter(spark, d):
    return grid.textbooks(grid.home_breadth(grid.history(t.citations(spark, d), CUT))).select("work", "breadth")


@query("top_per_area", f"{LADDER_BASE}, s as (select c.work, c.area, coalesce(round(fl.flow, 9), 0) score from cells c left join flow fl on fl.work = c.work and fl.area = c.area) select area, work, row_number() over (partition by area order by score desc, work) rank from s qualify rank <= 20")
def top_per_area(spark, d):
    return _listed(spark, d).select("area", "work", "rank")


def _scored(spark, d):
    f = grid.flows(t.citations(spark, d), t.work_areas(spark, d), CUT, RECENT)
    return labelled(spark, d).join(f, ["work", "area"], "left").withColumn("score", F.coalesce(rounded("flow", 9), F.lit(0.0)))


def _listed(spark, d):
    return rank.top_per(_scored(spark, d), "area", "score", ["work"], 20)


@query("list_lift", f"""{LADDER_BASE}, s as (select c.*, coalesce(round(fl.flow, 9), 0) score from cells c left join flow fl on fl.work = c.work and fl.area = c.area),
l as (select * from s qualify row_number() over (partition by area order by score desc, work) <= 20)
select (select count(*) from l) listed, round((select avg(pos::int) from l), 6) as precision, round((select avg(pos::int) from s), 6) base, round((select avg(pos::int) from l) / (select avg(pos::int) from s), 6) lift""")
def list_lift(spark, d):
    out = grid.list_lift(_listed(spark, d), labelled(spark, d), "pos")
    return out.select("listed", *(rounded(c, 6).alias(c) for c in ("precision", "base", "lift")))


@query("coverage", with_sql("paper") + ", r as (select distinct l_orderkey paper from lineitem where l_returnflag = 'R') select year, count(*) papers, round(avg((r.paper is not null)::int), 6) share from paper left join r using (paper) group by year")
def coverage(spark, d):
    r = t.load(spark, d, "lineitem", ["l_orderkey", "l_returnflag"]).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper"), F.lit(1).alias("has")).distinct()
    return t.papers(spark, d).join(r, "paper", "left").groupBy("year").agg(F.count("*").alias("papers"), rounded(F.avg(F.coalesce("has", F.lit(0))), 6).alias("share"))


@query("usable_strata", f"{BASE} select count(*) filter (where p > 0 and p < n) strata, coalesce(sum(p) filter (where p < n), 0)::bigint positives from (select area, sum(pos::int) p, count(*) n from cells group by area)")
def usable_strata(spark, d):
    g = labelled(spark, d).groupBy("area").agg(F.count_if("pos").alias("p"), F.count("*").alias("n"))
    return g.agg(F.count_if((F.col("p") > 0) & (F.col("p") < F.col("n"))).alias("strata"), F.coalesce(F.sum(F.when(F.col("p") < F.col("n"), F.col("p"))), F.lit(0)).alias("positives"))


@query("window_counts", with_sql("paper") + f" select count(*) filter (where year <= {CUT}) hist, count(*) filter (where year > {CUT} and year <= {LAST}) outcome, count(*) filter (where year > {CUT - RECENT} and year <= {CUT}) recent from paper")
def window_counts(spark, d):
    y = F.col("year")
    return t.papers(spark, d).agg(F.count_if(y <= CUT).alias("hist"), F.count_if((y > CUT) & (y <= LAST)).alias("outcome"), F.count_if((y > CUT - RECENT) & (y <= CUT)).alias("recent"))


@query("reference_spread", with_sql("paper", "cit", "home", "areas") + """, r as (select paper, area, home.home b from cit join home using (work))
select area, round(avg((b <> area)::int), 6) far, count(distinct b) areas from r group by area""")
def reference_spread(spark, d):
    r = t.citations(spark, d).join(t.work_areas(spark, d), "work")
    return r.groupBy("area").agg(rounded(F.avg((F.col("home") != F.col("area")).cast("int")), 6).alias("far"), F.countDistinct("home").alias("areas"))

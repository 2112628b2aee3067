"""Work-by-area grids: cells not yet filled at a cutoff, their features, ladders, surprise, follow-on.

Everything takes `cit` (paper, work, area, year), one row for each work a paper cites, and works by joins on
keys; only area-by-area tables, which don't grow with the papers, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks
from .rank import quantiles, top_per


def history(cit: DataFrame, cutoff: int) -> DataFrame:
    return cit.filter(F.col("year") <= cutoff)


def tools(cit: DataFrame, cutoff: int, min_cites: int) -> DataFrame:
    """work, n: works with at least min_cites citers up to the cutoff."""
    return history(cit, cutoff).groupBy("work").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cites)


def empty_cells(cit: DataFrame, areas: DataFrame, cutoff: int, min_cites: int, home: DataFrame | None = None) -> DataFrame:
    """work, area without a citation up to the cutoff; a work's own area is no cell. areas: a fixed small table."""
    t = tools(cit, cutoff, min_cites).select("work")
    grid = t.withColumn("__k", F.lit(1)).join(F.broadcast(areas.select("area").withColumn("__k", F.lit(1))), "__k").drop("__k")
    cells = grid.join(history(cit, cutoff).select("work", "area").distinct(), ["work", "area"], "left_anti")
    if home is not None:
        cells = cells.join(home.select("work", F.col("home").alias("area")), ["work", "area"], "left_anti")
    return cells


def outcomes(cells: DataFrame, cit: DataFrame, first: int, last: int, min_pos: int) -> DataFrame:
    """cells with the papers of first..last that filled them, and whether they are enough."""
    seen = cit.filter(F.col("year").between(first, last)).groupBy("work", "area").agg(F.count("*").alias("outcome"))
    out = cells.join(seen, ["work", "area"], "left").withColumn("outcome", F.coalesce("outcome", F.lit(0)).cast("long"))
    return out.withColumn("pos", F.col("outcome") >= min_pos)


def work_features(cit: DataFrame, cutoff: int, recent: int, min_cites: int) -> DataFrame:
    """work, cites, recent, reach: logs of citers and recent citers, and number of areas."""
    h = history(cit, cutoff).groupBy("work").agg(
        F.count("*").alias("n"), F.sum((F.col("year") > cutoff - recent).cast("long")).alias("r"), F.countDistinct("area").alias("reach")
    )
    return h.filter(F.col("n") >= min_cites).select("work", F.log1p("n").alias("cites"), F.log1p("r").alias("recent"), "reach")


def flows(cit: DataFrame, home: DataFrame, cutoff: int, recent: int) -> DataFrame:
    """work, area, flow: sum over areas B of the work's share of citers in B times the share of A's recent citations that go to works of B."""
    h = history(cit, cutoff)
    share = h.groupBy("work", F.col("area").alias("b")).agg(F.count("*").alias("n"))
    share = share.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("work")))
    sent = h.filter(F.col("year") > cutoff - recent).join(home, "work").groupBy("area", F.col("home").alias("b")).agg(F.count("*").alias("m"))
    sent = sent.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy("area")))
    return share.join(F.broadcast(sent), "b").groupBy("work", "area").agg(F.sum(F.col("share") * F.col("w")).alias("flow"))


def cross_listed(cit: DataFrame, secondary: DataFrame, cutoff: int) -> DataFrame:
    """work, area, xlist: citers up to the cutoff with the area among their secondary ones. Tasks are as many as the rows of both need."""
    h = sinks.settled(history(cit, cutoff).select("paper", "work"))
    second = sinks.settled(secondary.select("paper", F.col("area2").alias("area")))
    n = sinks.partitions(h, 2 * (h.count() + second.count()))
    x = h.repartition(n, "paper").join(second.repartition(n, "paper").hint("merge"), "paper").select("work", "area")
    return x.repartition(n, "work", "area").groupBy("work", "area").agg(F.count("*").alias("xlist"))


#: Areas of a mask; areas beyond have masks of their own, told apart by `word`.
BITS = 63


def area_codes(areas: DataFrame) -> DataFrame:
    """area, code: the distinct areas numbered from 0; areas are few by definition."""
    x = areas.select("area").filter(F.col("area").isNotNull()).distinct()
    return F.broadcast(x.withColumn("code", F.row_number().over(Window.orderBy("area")) - 1))


def masked(df: DataFrame, by: str, codes: DataFrame) -> DataFrame:
    """by, word, mask: the set of areas of each `by`, one bit for each area; tasks put sets together before they travel."""
    x = df.join(codes, "area").select(by, F.floor(F.col("code") / BITS).cast("int").alias("word"), (F.col("code") % BITS).alias("__bit"))
    return x.groupBy(by, "word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("mask"))


def unmasked(masks: DataFrame, codes: DataFrame) -> DataFrame:
    """work, area: the areas of each work's sets (work, word, mask), each once."""
    x = masks.groupBy("work", "word").agg(F.bit_or("mask").alias("mask"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit("mask", b) == 1)
    x = x.select("work", "word", F.explode(bits).alias("__bit")).select("work", (F.col("word") * BITS + F.col("__bit")).alias("code"))
    return x.join(codes, "code").select("work", "area")


def shared_authors(cit: DataFrame, papers: DataFrame, authors: DataFrame, cutoff: int) -> DataFrame:
    """work, area: an author wrote a citer of the work and a paper of the area, both up to the cutoff.

    An author's areas come as one set, so a work meets each of its authors once, not once for each of their areas.
    """
    mine = history(cit, cutoff).select("paper", "work").join(authors, "paper").select("work", "author")
    theirs = papers.filter(F.col("year") <= cutoff).join(authors, "paper").select("author", "area")
    codes = area_codes(papers)
    return unmasked(mine.join(masked(theirs, "author", codes), "author").select("work", "word", "mask"), codes)


def second_hand(cit: DataFrame, papers: DataFrame, refs: DataFrame, cutoff: int) -> DataFrame:
    """work, area: a paper of the area cites a citer of the work, both up to the cutoff."""
    mine = history(cit, cutoff).select(F.col("paper").alias("cited"), "work")
    theirs = papers.filter(F.col("year") <= cutoff).join(refs, "paper").select("cited", "area")
    codes = area_codes(papers)
    return unmasked(mine.join(masked(theirs, "cited", codes), "cited").select("work", "word", "mask"), codes)


def ladder(cells: DataFrame, xlist: DataFrame, shared: DataFrame, second: DataFrame, flow: DataFrame, quantile: float = 0.75) -> DataFrame:
    """cells with rung 1 shared paper, 2 shared author, 3 second-hand, 4 neighbouring (flow in the top quarter), 5 cold; the lowest wins."""
    mark = lambda df, name: df.select("work", "area", F.lit(True).alias(name)).distinct()
    keys = ["work", "area"]
    x = cells.join(mark(xlist, "one"), keys, "left").join(mark(shared, "two"), keys, "left").join(mark(second, "three"), keys, "left")
    x = sinks.settled(x.join(flow, keys, "left").withColumn("flow", F.coalesce("flow", F.lit(0.0))))
    edge = quantiles(x, "flow", [quantile]).select(F.get("edges", F.lit(0)).alias("edge"))
    rung = F.when(F.col("one"), 1).when(F.col("two"), 2).when(F.col("three"), 3).when(F.col("flow") >= F.col("edge"), 4).otherwise(5)
    return x.crossJoin(F.broadcast(edge)).select(*cells.columns, "flow", rung.cast("long").alias("rung"))


def six_rungs(cells: DataFrame, cit: DataFrame, areas: DataFrame, xlist: DataFrame, shared: DataFrame, second: DataFrame, flow: DataFrame, cutoff: int) -> DataFrame:
    """As ladder, with 4 a citer in an area of the same parent, 5 flow in the top quarter of the positive ones, 6 cold."""
    mark = lambda df, name: df.select("work", "area", F.lit(True).alias(name)).distinct()
    keys = ["work", "area"]
    siblings = areas.select(F.col("area").alias("own"), "parent").join(areas, "parent")  # of a fixed size, as areas
    codes = area_codes(areas)
    near = unmasked(history(cit, cutoff).select("work", F.col("area").alias("own")).join(F.broadcast(masked(siblings, "own", codes)), "own"), codes)
    x = cells
    for df, name in ((xlist, "one"), (shared, "two"), (second, "three"), (near, "four")):
        x = x.join(mark(df, name), keys, "left")
    x = sinks.settled(x.join(flow, keys, "left").withColumn("flow", F.coalesce("flow", F.lit(0.0))))
    edge = quantiles(x.filter("flow > 0"), "flow", [0.75]).select(F.get("edges", F.lit(0)).alias("edge"))
    warm = (F.col("flow") > 0) & (F.col("flow") >= F.col("edge"))
    rung = F.when(F.col("one"), 1).when(F.col("two"), 2).when(F.col("three"), 3).when(F.col("four"), 4).when(warm, 5).otherwise(6)
    return x.crossJoin(F.broadcast(edge)).select(*cells.columns, rung.cast("long").alias("rung"))


def cocitation(cit: DataFrame) -> DataFrame:
    """a, b, f: share of the works used in b that a uses too."""
    used = cit.select("work", "area").distinct()
    both = used.toDF("work", "a").join(used.toDF("work", "b"), "work").groupBy("a", "b").agg(F.count("*").alias("n"))
    own = both.filter("a = b").select("b", F.col("n").alias("all"))
    return both.join(F.broadcast(own), "b").select("a", "b", (F.col("n") / F.col("all")).alias("f"))


def spans(cit: DataFrame, f: DataFrame, areas: DataFrame) -> DataFrame:
    """work, area, bits: surprise of the area given the areas of the work's citers, -log2(sum of share times f)."""
    share = cit.groupBy("work", F.col("area").alias("b")).agg(F.count("*").alias("n"))
    share = share.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("work")))
    known = share.join(F.broadcast(f), "b").groupBy("work", F.col("a").alias("area")).agg(F.sum(F.col("s") * F.col("f")).alias("p"))
    grid = share.select("work", F.lit(1).alias("k")).distinct().join(F.broadcast(areas.select("area", F.lit(1).alias("k"))), "k").drop("k")
    p = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-12))
    return grid.join(known, ["work", "area"], "left").select("work", "area", (-F.log2(p)).alias("bits"))


def arrivals(cit: DataFrame, min_prior: int, watch: int) -> DataFrame:
    """work, area, year, prior, arriving, follow_on of each first arrival with enough citers of earlier years."""
    per = cit.groupBy("work", "area", "year").agg(F.count("*").alias("n"))
    first = per.groupBy("work", "area").agg(F.min("year").alias("y0"))
    by_year = per.groupBy("work", "year").agg(F.sum("n").alias("n"))
    prior = first.join(by_year, "work").filter("year < y0").groupBy("work", "area").agg(F.sum("n").alias("prior"))
    own = first.join(per, ["work", "area"]).groupBy("work", "area", "y0").agg(
        F.sum(F.when(F.col("year") == F.col("y0"), F.col("n")).otherwise(0)).alias("arriving"),
        F.sum(F.when((F.col("year") > F.col("y0")) & (F.col("year") <= F.col("y0") + watch), F.col("n")).otherwise(0)).alias("follow_on"),
    )
    return own.join(prior, ["work", "area"]).filter(F.col("prior") >= min_prior).select("work", "area", F.col("y0").alias("year"), "prior", "arriving", "follow_on")


def follow_on(cit: DataFrame, arrived: DataFrame, watch: int) -> DataFrame:
    """lag, n, total: follow-on papers of all arrivals by years since, and their running total."""
    x = arrived.select("work", "area", F.col("year").alias("y0")).join(cit, ["work", "area"]).withColumn("lag", F.col("year") - F.col("y0"))
    n = x.filter(F.col("lag").between(1, watch)).groupBy("lag").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)))


def home_breadth(cit: DataFrame) -> DataFrame:
    """work, home (area with most citers, the smaller on ties), breadth (number of areas)."""
    n = cit.groupBy("work", "area").agg(F.count("*").alias("n"))
    return n.groupBy("work").agg(F.max_by("area", F.struct("n", -F.col("area"))).alias("home"), F.count("*").alias("breadth"))


def nearest(f: DataFrame, k: int = 3) -> DataFrame:
    """a, b, rank: the k other areas whose column a takes the largest share of, ties by area."""
    return top_per(f.filter("a <> b"), "a", "f", ["b"], k)


def surprise(cells: DataFrame, cit: DataFrame, xlist: DataFrame, f: DataFrame, cutoff: int) -> DataFrame:
    """cells labelled knocking (a citer lists the area), next door (used in one of its 3 nearest areas), or surprising."""
    keys = ["work", "area"]
    door = history(cit, cutoff).select("work", F.col("area").alias("b")).distinct().join(F.broadcast(nearest(f).select(F.col("a").alias("area"), "b")), "b")
    x = cells.join(xlist.select(*keys, F.lit(True).alias("knock")).distinct(), keys, "left")
    x = x.join(door.select(*keys, F.lit(True).alias("door")).distinct(), keys, "left")
    return x.select(*cells.columns, F.when(F.col("knock"), "knocking").when(F.col("door"), "next door").otherwise("surprising").alias("label"))


def textbooks(breadths: DataFrame, q: float = 0.9) -> DataFrame:
    """Works whose breadth reaches the quantile."""
    edge = quantiles(breadths, "breadth", [q]).select(F.get("edges", F.lit(0)).alias("edge"))
    return breadths.crossJoin(F.broadcast(edge)).filter("breadth >= edge").drop("edge")


def list_lift(listed: DataFrame, population: DataFrame, hit: str) -> DataFrame:
    """precision of the listed rows over the base rate of the population; null where the base is 0."""
    a = listed.agg(F.count("*").alias("listed"), F.avg(F.col(hit).cast("double")).alias("precision"))
    b = population.agg(F.avg(F.col(hit).cast("double")).alias("base"))
    return a.crossJoin(b).withColumn("lift", F.when(F.col("base") > 0, F.col("precision") / F.col("base")))


#: Negatives offered to each anchor in the first round; every further round offers twice as many of the next ones.
OFFERED = 4


def negatives(anchors: DataFrame, cit: DataFrame) -> DataFrame:
    """anchors (work, anchor, home, ...) with `negative`: the first paper of the home area, from the anchor's place on in hash order and around, that doesn't cite the work.

    Papers of an area are numbered by hash: within the 256 lots of the first two digits, after the counts of the lots
    before, so no area is ordered in one place. An anchor without a negative isn't returned.
    """
    h = F.sha2(F.concat_ws("|", "home", "paper"), 256)
    pool = sinks.settled(cit.select(F.col("area").alias("home"), "paper").distinct()).withColumn("h", h).withColumn("lot", F.substring("h", 1, 2))
    lots = pool.groupBy("home", "lot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("home").orderBy("lot")
    lots = lots.withColumn("first", F.sum("n").over(before) - F.col("n")).withColumn("size", F.sum("n").over(Window.partitionBy("home"))).drop("n")
    place = F.row_number().over(Window.partitionBy("home", "lot").orderBy("h"))
    # every round reads the pool
    pool = sinks.settled(pool.withColumn("k", place).join(lots, ["home", "lot"]).select("home", (F.col("first") + F.col("k") - 1).alias("place"), F.col("paper").alias("negative")))
    sizes = lots.select("home", "size").distinct()
    cites = cit.select("work", F.col("paper").alias("negative"))
    open_ = sinks.settled(anchors.join(sizes, "home").withColumn("start", F.pmod(F.xxhash64("work", "anchor"), F.col("size"))))
    found, at, more = [], 0, OFFERED
    keys = ["work", "anchor", "home"]
    while True:
        some = open_.filter(F.col("size") > at)
        if some.isEmpty():
            break
        steps = F.sequence(F.lit(at), F.least(F.lit(at + more), F.col("size")).cast("int") - 1)
        offers = some.withColumn("step", F.explode(steps)).withColumn("place", F.pmod(F.col("start") + F.col("step"), F.col("size")))
        offers = offers.join(pool, ["home", "place"]).join(cites, ["work", "negative"], "left_anti")
        now = sinks.settled(offers.groupBy(*keys).agg(F.min_by("negative", "step").alias("negative")))
        found.append(now)
        open_ = sinks.settled(some.join(now, keys, "left_anti"))
        at, more = at + more, 2 * more
    chosen = anchors.select(*keys).limit(0).withColumn("negative", F.lit(None).cast(dict(cit.dtypes)["paper"]))
    for part in found:
        chosen = chosen.unionByName(part)
    return anchors.join(chosen, keys)

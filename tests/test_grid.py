"""Toy grids with known answers."""

from pyspark.sql import functions as F

from tessera.operators import grid


def test_ladder_rungs(spark):
    """Five cells of one tool at cutoff 2010: shared paper, second-hand, shared author, neighbouring, cold."""
    papers = [("p0", 2005, "AG"), ("p1", 2005, "CO"), ("p2", 2005, "DS"), ("p3", 2005, "PR"), ("p4", 2005, "GT"), ("p5", 2012, "GT")]
    p = spark.createDataFrame(papers, "paper string, year int, area string")
    cit = p.join(spark.createDataFrame([("p0", "T"), ("p5", "T")], "paper string, work string"), "paper")
    refs = spark.createDataFrame([("p1", "p0")], "paper string, cited string")
    authors = spark.createDataFrame([("p0", "x"), ("p2", "x")], "paper string, author string")
    secondary = spark.createDataFrame([("p0", "NT")], "paper string, area2 string")
    cells = spark.createDataFrame([("T", a) for a in ("NT", "CO", "DS", "PR", "GT")], "work string, area string")
    flow = spark.createDataFrame([("T", "NT", 0.3), ("T", "CO", 0.1), ("T", "DS", 0.2), ("T", "PR", 0.9), ("T", "GT", 0.05)], "work string, area string, flow double")
    shared = grid.shared_authors(cit, p, authors, 2010).filter("area <> 'AG'")
    second = grid.second_hand(cit, p, refs, 2010)
    got = grid.ladder(cells, grid.cross_listed(cit, secondary, 2010), shared, second, flow)
    assert {r["area"]: r["rung"] for r in got.collect()} == {"NT": 1, "CO": 3, "DS": 2, "PR": 4, "GT": 5}


def test_cocitation_and_span(spark):
    used = [("w0", 0), ("w1", 0), ("w1", 1), ("w2", 1), ("w3", 2)]
    cit = spark.createDataFrame([(i, w, a, 2000) for i, (w, a) in enumerate(used)], "paper int, work string, area int, year int")
    f = {(r["a"], r["b"]): r["f"] for r in grid.cocitation(cit).collect()}
    assert f[0, 0] == f[1, 1] == f[2, 2] == 1 and f[1, 0] == 0.5 and (2, 0) not in f
    more = cit.union(spark.createDataFrame([(9, "w4", 1, 2000), (10, "w4", 2, 2000)], cit.schema))
    f = grid.cocitation(more)
    prior = [("x", 0)] * 4 + [("y", 0)] * 2 + [("y", 1)] * 2 + [("z", 1)] * 4
    cells = spark.createDataFrame([(i, w, a, 2000) for i, (w, a) in enumerate(prior)], cit.schema)
    bits = {(r["work"], r["area"]): r["bits"] for r in grid.spans(cells, f, spark.createDataFrame([(0,), (1,), (2,)], "area int")).collect()}
    assert bits["x", 2] > bits["y", 2] > bits["z", 2]


def test_arrivals(spark):
    years, areas = [2000, 2000, 2001, 2001, 2002, 2003, 2003, 2004, 2005, 2006], [0, 0, 0, 1, 0, 0, 2, 2, 2, 1]
    cit = spark.createDataFrame([(i, "w", a, y) for i, (y, a) in enumerate(zip(years, areas, strict=True))], "paper int, work string, area int, year int")
    got = grid.arrivals(cit, 5, 5).collect()
    assert [(r["area"], r["year"], r["prior"], r["arriving"], r["follow_on"]) for r in got] == [(2, 2003, 5, 1, 2)]
    lags = grid.follow_on(cit, grid.arrivals(cit, 5, 5), 5).orderBy("lag").collect()
    assert [(r["lag"], r["n"], r["total"]) for r in lags] == [(1, 1, 1), (2, 1, 2)]


def test_nearest_areas_break_ties_by_index(spark):
    m = [(1, 0.2, 0.9, 0.5), (0.3, 1, 0.1, 0.2), (0.4, 0.4, 1, 0.1), (0, 0, 0, 1)]
    f = spark.createDataFrame([(a, b, float(x)) for a, row in enumerate(m) for b, x in enumerate(row)], "a int, b int, f double")
    got = grid.nearest(f, 2).orderBy("a", "rank").collect()
    assert [r["b"] for r in got if r["a"] == 0] == [2, 3] and [r["b"] for r in got if r["a"] == 2] == [0, 1]


def test_lists_lift_and_textbooks(spark):
    rows = [(0, 0, 0.1, True), (1, 0, 0.9, False), (2, 0, 0.5, False), (3, 1, 0.7, False), (4, 1, 0.2, True), (5, 1, 0.8, False)]
    x = spark.createDataFrame(rows, "id int, area int, score double, hit boolean")
    from tessera.operators.rank import top_per

    top = top_per(x, "area", "score", ["id"], 2).orderBy("area", "rank").collect()
    assert [r["id"] for r in top] == [1, 2, 5, 3]
    assert grid.list_lift(x.filter("id IN (0, 4)"), x, "hit").first()["lift"] == 3.0
    assert grid.list_lift(x.filter("id IN (1, 2)"), x, "hit").first()["lift"] == 0.0
    assert grid.list_lift(x, x.withColumn("hit", F.lit(False)), "hit").first()["lift"] is None
    breadth = spark.range(1, 21).select(F.col("id").alias("work"), F.col("id").alias("breadth"))
    assert grid.textbooks(breadth, 0.9).count() == 2


def test_home_takes_the_smaller_area_on_ties(spark):
    cit = spark.createDataFrame([(0, "w", 3, 1), (1, "w", 1, 1), (2, "w", 2, 1), (3, "w", 1, 1), (4, "w", 3, 1)], "paper int, work string, area int, year int")
    r = grid.home_breadth(cit).first()
    assert (r["home"], r["breadth"]) == (1, 3)


def test_empty_cells_leave_out_filled_ones_and_home(spark):
    cit = spark.createDataFrame([(i, "w", 0, 2000) for i in range(3)], "paper int, work string, area int, year int")
    areas = spark.createDataFrame([(0,), (1,), (2,)], "area int")
    home = spark.createDataFrame([("w", 2)], "work string, home int")
    assert [r["area"] for r in grid.empty_cells(cit, areas, 2000, 3, home).collect()] == [1]
    assert grid.empty_cells(cit, areas, 2000, 4, home).count() == 0

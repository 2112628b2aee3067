"""What the third round's findings asked for: the same rows by steps that don't grow faster than their input."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators import corpus as cp
from tessera.operators import grid, models, nulls, pairs
from tessera.operators import vectors as vec
from tessera.plans import pairs as plans
from tessera.sources import sinks
from test_corpus_and_nulls import brute, frames, items


def test_angle_auc_counts_in_bounded_chunks(spark):
    """Against all pairs; 400 copies make more pairs of one angle than two bytes count."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 8))
    v = np.concatenate([np.repeat(v[:1], 400, axis=0), v])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    area = [k % 3 for k in range(len(v))]
    rows = spark.createDataFrame([(k, x.tolist(), a) for k, (x, a) in enumerate(zip(v, area, strict=True))], "id long, u array<double>, area long")
    i, j = np.triu_indices(len(v), 1)
    angle = np.round(np.degrees(np.arccos(np.clip((v @ v.T)[i, j], -1, 1))), 6)
    same = np.array(area)[i] == np.array(area)[j]
    pos, neg = angle[same], np.sort(angle[~same])
    won = (len(neg) - np.searchsorted(neg, pos, side="right")).sum() + 0.5 * (np.searchsorted(neg, pos, side="right") - np.searchsorted(neg, pos)).sum()
    for groups in (1, 3):
        assert vec.angle_chunks(rows, "area", groups).count() <= 180_000_000 * 2 // (1 << vec.CHUNK) + 1
        got = vec.angle_auc(rows, "area", groups).first()
        assert (got["positives"], got["negatives"]) == (len(pos), len(neg))
        assert got["auc"] == pytest.approx(won / (len(pos) * len(neg)), abs=1e-12)


def test_areas_travel_as_sets(spark):
    """An author of papers in 150 areas, more than one word holds, meets each work once; the areas that come out are all of them."""
    papers = spark.createDataFrame([(k, 2000, f"area {k % 150}") for k in range(300)], "paper long, year long, area string")
    authors = spark.createDataFrame([(k, 0) for k in range(300)], "paper long, author long")
    cit = papers.filter("paper < 40").withColumn("work", F.col("paper") % 4)
    codes = grid.area_codes(papers)
    assert grid.masked(papers.withColumn("author", F.lit(0)), "author", codes).count() == 3
    got = grid.shared_authors(cit, papers, authors, 2010).collect()
    assert len(got) == 4 * 150 and {tuple(r) for r in got} == {(w, f"area {a}") for w in range(4) for a in range(150)}
    refs = spark.createDataFrame([(200, 0), (201, 0), (202, 1)], "paper long, cited long")
    assert {tuple(r) for r in grid.second_hand(cit, papers, refs, 2010).collect()} == {(0, "area 50"), (0, "area 51"), (1, "area 52")}


def test_nearest_takes_ties_by_column():
    """Against sorting whole rows, with values that only rounding makes equal, and some that aren't finite."""
    rng = np.random.default_rng(3)
    s = np.round(rng.normal(size=(40, 900)), 1) + rng.choice([0, 2e-10, -2e-10], size=(40, 900))
    s[:, 5], s[3, :895], s[4, 7] = -np.inf, -np.inf, np.nan
    for k in (1, 10, 30):
        row, col, value = vec.nearest(s, k)
        r = np.round(np.where(np.isfinite(s), s, -np.inf), 9)
        want = [(i, j, r[i, j]) for i in range(40) for j in np.argsort(-r[i], kind="stable")[:k] if np.isfinite(r[i, j])]
        assert list(zip(row.tolist(), col.tolist(), value.tolist(), strict=True)) == want


def test_svd_reads_the_rows_once(spark, monkeypatch):
    """Against numpy, without the iterations that read all rows each."""
    monkeypatch.setattr(models.RowMatrix, "computeSVD", None)
    m = np.random.default_rng(2).normal(size=(30, 12))
    rows = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(12)], "item long, col int, w double")
    got = np.array([r["v"] for r in models.svd(rows, "item", "col", "w", 3).orderBy("item").collect()])
    x = m @ np.linalg.svd(m, full_matrices=False)[2][:3].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, x @ x.T, atol=1e-9)


def test_drawn_pairs_are_never_broadcast(spark):
    """Pairs that draws spell out meet their items by groups; sums of a draw are those of brute force, whatever the groups."""
    data = items()
    corpus = cp.assemble(*frames(spark, data))
    feat, _ = brute(data, 5.0)
    hist = {}
    for f in feat.values():
        hist[f[0]] = hist.get(f[0], 0) + f[4]
    hist = {b: n for b, n in hist.items() if n}
    pop = nulls.population(spark.createDataFrame(list(hist.items()), "bin long, n long"))
    place = {r["bin"]: r["place"] for r in pop.collect()}
    total = sum(hist.values())
    pairs = cp.dic.settled(spark.createDataFrame(sorted(feat)[::5], "i long, j long"))
    for how, drawn in (("sub", nulls.substituted(pairs, len(data[0]), 3, "x", False)), ("perm", nulls.permuted(pairs, 3, "x", once=False))):
        want = {}
        for d, i, j in {tuple(r) for r in drawn.select("draw", "i", "j").collect()}:
            if feat[i, j][4]:
                want.setdefault(d, []).append(place[feat[i, j][0]])
        want = {d: (len(p), (sum(p) - len(p) ** 2 / 2) / (len(p) * (total - len(p)))) for d, p in want.items() if len(p) >= 2}
        for groups in (None, 1, 3):
            got = nulls.scored(drawn, corpus, pop, "hard", 5.0, 2, groups=groups)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastExchange" not in plan if how == "sub" else "SortMergeJoin [i#" in plan and "SortMergeJoin [draw#" in plan
            assert {r["draw"]: (r["k"], pytest.approx(r["auc"])) for r in got.collect()} == want


def test_a_large_draw_is_spelled_out_in_several_tasks(spark):
    pop = nulls.population(spark.createDataFrame([(0, 1000), (3, 3000), (7, 6000)], "bin long, n long"))
    sizes = spark.createDataFrame([(0, 5000), (1, 7), (2, 0)], "draw long, k long")
    whole, cut = ({r["draw"]: r["auc"] for r in nulls.independent(sizes, pop, "i", chunk).collect()} for chunk in (1 << 16, 64))
    assert whole == cut and set(cut) == {0, 1}


def test_items_travel_by_tasks_and_other_texts_stay(spark, monkeypatch):
    """Six times as many items travel to as many groups; texts without a vector aren't cut into tokens."""
    few, many = (blocks.group_count(n, 24, cp.GROUP * cp.BLOCK, cp.BLOCK) for n in (51_282, 307_692))
    assert few == many
    cut = []
    monkeypatch.setattr(plans.tx, "tokens", lambda docs, *_: cut.append(docs.count()) or docs.toDF("item", "key"))
    monkeypatch.setattr(plans.cp, "assemble", lambda *frames: frames)
    plans.assembled(spark, "/root/testdata/sf0.01")
    assert cut == [500]  # of 1,000


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Counts of pairs and of cross listings are dealt to as many tasks as their rows need, and stay what they are."""
    monkeypatch.setattr(sinks, "ROWS", 40)
    held = [(k, (k * 7 + m) % 30) for k in range(50) for m in range(4)]
    want = {}
    for k in range(50):
        for i, j in itertools.combinations(sorted(m for n, m in held if n == k), 2):
            want[i, j] = want.get((i, j), 0) + 1
    got = pairs.co_cited(spark.createDataFrame(held, "list long, item long"))
    assert {(r["i"], r["j"]): r["n"] for r in got.collect()} == want
    assert "hashpartitioning(i#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 8), REPARTITION_BY_NUM" in plan  # 300 pairs
    cit = spark.createDataFrame([(p, w, 0, 2000) for p, w in held], "paper long, work long, area long, year long")
    second = spark.createDataFrame([(k, a) for k in range(0, 50, 2) for a in (1, 2)], "paper long, area2 long")
    listed = grid.cross_listed(cit, second, 2010)
    assert {(r["work"], r["area"]): r["xlist"] for r in listed.collect()} == dict(Counter((w, a) for p, w in held if p % 2 == 0 for a in (1, 2)))
    assert ", 13), REPARTITION_BY_NUM" in listed._jdf.queryExecution().executedPlan().toString()

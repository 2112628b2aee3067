"""Pair joins, text functions, sources, certificates, greedy choices and models on small inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import certify, greedy, grid, models, pairs
from tessera.operators import vectors as vec
from tessera.sources import tables as t


def test_jaccard_and_eligibility(spark):
    items = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "d")], "item int, key string")
    got = {(r["i"], r["j"]): (r["overlap"], r["jaccard"]) for r in pairs.jaccard(items).collect()}
    assert got == {(0, 1): (1, pytest.approx(1 / 3))}
    all_pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "i int, j int")
    assert {(r["i"], r["j"]) for r in pairs.eligible(all_pairs, pairs.rare(items)).collect()} == {(0, 2), (1, 2)}


def test_bridge_triples(spark):
    items = [(c, k) for c, keys in {"a": "12", "b": "34", "c": "1234", "d": "12"}.items() for k in keys]
    x = pairs.rare(spark.createDataFrame(items, "item string, key string"))
    area = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 1)], "item string, area int")
    got = {(r["a"], r["b"], r["c"]) for r in pairs.bridge_triples(x, area).collect()}
    assert got == {("a", "b", "c")}
    cites = spark.createDataFrame([("b", "a")], "item string, cited string")
    assert pairs.bridge_triples(x, area, cites).count() == 0


def test_as_of_takes_the_last_header(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 10), (3, "f", 2), (4, "g", 9)], "id int, file string, line int")
    heads = spark.createDataFrame([("f", 3, "one"), ("f", 10, "two")], "file string, line int, name string")
    got = {r["id"]: r["name"] for r in pairs.as_of(points, heads, "file", "line", "name").collect()}
    assert got == {1: "one", 2: "two", 3: None, 4: None}


def test_outermost_keeps_one_of_equal_spans(spark):
    s = spark.createDataFrame([("f", 1, 9, 0), ("f", 2, 5, 1), ("f", 1, 9, 2), ("f", 8, 12, 3)], "by string, s int, e int, k int")
    assert {r["k"] for r in pairs.outermost(s, "by", "s", "e", "k").collect()} == {0, 3}


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([('TAG {"a": 1}',), ("noise",), ("TAG {bad",)], "value string")
    assert [r["a"] for r in t.tagged(rows, "TAG ", "a int").collect()] == [1, None]
    hit = t.hits(spark.createDataFrame([("rev:file.lean:12:text: more",)], "value string")).first()
    assert (hit["rev"], hit["file"], hit["line"], hit["text"]) == ("rev", "file.lean", 12, "text: more")
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"theorem": f"t{i}", "deps": ["a"]}) for i in range(3)))
    assert t.jsonl(spark, str(tmp_path / "x.jsonl"), "theorem string, deps array<string>").count() == 3
    (tmp_path / "l.txt").write_text(" one \n\n two\n")
    assert [r["line"] for r in t.lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]
    (tmp_path / "w.tsv").write_text('10.1/"a"\n10.2/b\n')
    assert t.single_column(spark, str(tmp_path / "w.tsv"), "doi").count() == 2
    (tmp_path / "c.csv").write_text("name,n\na,1\n")
    assert t.labelled_csv(spark, str(tmp_path / "c.csv"), "name string, n int").first()["n"] == 1


def test_text_functions(spark):
    x = spark.createDataFrame([("Library.Algebra.Ring",), ("Plain",)], "m string")
    assert [r[0] for r in x.select(tx.second_part("m")).collect()] == ["Algebra", ""]
    assert [r[0] for r in x.select(tx.second_part("m", F.col("m"))).collect()] == ["Algebra", "Plain"]
    ids = spark.createDataFrame([("0704.0001",), ("math/9912345",), ("math/0001001",)], "id string")
    assert [r[0] for r in ids.select(tx.id_year("id")).collect()] == [2007, 1999, 2000]
    grams = tx.hashed_ngrams(spark.createDataFrame([(1, "a b"), (2, ""), (3, "  ")], "id int, text string"), "id", "text").collect()
    assert {r["item"] for r in grams} == {1} and sum(r["value"] ** 2 for r in grams) == pytest.approx(1)


def test_registry_and_its_faults(spark):
    ids = spark.createDataFrame([(0,), (1,), (2,)], "id int")
    rel = lambda same, more=(), skip=(): spark.createDataFrame([(a, b, (a, b) in same or a == b) for a in range(3) for b in range(a, 3) if (a, b) not in skip] + list(more), "a int, b int, same boolean")
    good = rel({(0, 1)})
    assert certify.relation_faults(ids, good).count() == 0
    assert {r["id"]: r["rep"] for r in certify.registry(ids, good).collect()} == {0: 0, 1: 0, 2: 2}
    kinds = lambda p: {r["fault"] for r in certify.relation_faults(ids, p).collect()}
    assert "incomplete" in kinds(rel({(0, 1)}, skip={(1, 2)}))
    assert "transitive" in kinds(rel({(0, 1), (1, 2)}))
    assert "duplicate" in kinds(rel({(0, 1)}, more=[(0, 1, True)]))
    assert "order" in kinds(rel({(0, 1)}, more=[(2, 0, False)]))
    payload = spark.createDataFrame([(0, "p"), (1, "q"), (2, "p")], "id int, payload string")
    assert certify.payload_faults(certify.registry(ids, good), payload).count() == 1


def test_lookup_fails_closed(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    assert certify.lookup(table.select("k"), table, "k").count() == 1
    with pytest.raises(certify.CheckError):
        certify.lookup(spark.createDataFrame([("b",)], "k string"), table, "k")


@pytest.mark.parametrize(
    ("a", "b", "relation"),
    [
        ([[0, 0], [1, 0], [0, 1]], [[3, 3], [4, 3]], "disjoint"),
        ([[0, 0], [2, 0], [0, 2]], [[0.5, 0.5], [3, 3]], "intersect"),
        ([[0, 0], [1, 1]], [[0, 1], [1, 0]], "intersect"),
        ([[0.0], [1.0]], [[1.0 + 5e-10], [2.0]], "unresolved"),
        ([[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0.2, 0.2, 1.0]], "disjoint"),
        ([[0, 0]], [[0, 0]], "intersect"),
    ],
)
def test_hull_relation_is_certified(a, b, relation):
    assert certify.hull_relation(np.array(a, float), np.array(b, float))[0] == relation
    assert certify.hull_relation(np.array(b, float)[::-1], np.array(a + a, float))[0] == relation


def test_hull_contact():
    square = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)
    assert certify.contact_extent(square, square + [1, 1])[0] == "point"
    kind, size = certify.contact_extent(square, square + [1, 0])
    assert kind == "extended" and size == pytest.approx(1, abs=1e-3)
    assert certify.contact_extent(square, square + 5)[0] == "none"


def test_hulls_of_many_points_need_no_differences():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3000, 3))
    assert certify.hull_relation(a, a[:200] * 0.1)[0] == "intersect"
    kind, gap = certify.hull_relation(a, rng.normal(size=(2500, 3)) + [20, 0, 0])
    assert kind == "disjoint" and gap > 5


def test_vector_faults_are_each_reported(spark):
    unit = np.eye(4)
    far = (unit[0] + unit[1]) / np.sqrt(2)
    v = {0: unit[0], 1: unit[1], 2: unit[2], 3: unit[3], 4: far, 5: unit[2] * 2, 6: unit[3] * np.nan, 7: -unit[0], 8: far}
    again = {**v, 3: unit[3] + [0, 0, 0, 1e-5], 7: v[7]}
    again.pop(1)
    frame = lambda x: spark.createDataFrame([(k, [float(c) for c in r]) for k, r in x.items()], "id long, v array<double>")
    tokens = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [3]), (3, None), (4, None), (7, [1, 2])], "id long, tokens array<int>")
    got = {(r["fault"], r["a"], r["b"]) for r in certify.vector_faults(frame(v), frame(again), tokens).collect()}
    assert got == {("missing", 1, None), ("nonfinite", 6, None), ("nonunit", 5, None), ("nonunit", 3, None), ("drift", 3, None), ("collapse", 4, 8), ("tokens", 0, 1), ("tokens", 0, 7)}


def test_close_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5))
    x[50:90] = x[:40] + rng.normal(scale=0.02, size=(40, 5))
    x[100:103] = x[5]
    got = {(r["a"], r["b"]) for r in certify.close_pairs(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>"), 0.05).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.05), strict=True) if a < b}
    # of equal vectors the first stands for all
    first = {k: min(j for j in range(200) if (x[j] == x[k]).all()) for k in range(200)}
    assert got == {(a, b) for a, b in want if first[a] == a and (first[b] == b or first[b] == a)} and len(got) > 20


def test_link_reasons_in_order(spark):
    files = spark.createDataFrame([(1, "f"), (2, "g"), (3, "f"), (4, "h"), (5, "i"), (6, "j"), (7, "k"), (8, "j")], "item long, file string")
    edges = spark.createDataFrame([(7, 1), (7, 2), (4, 5), (6, 4), (8, 3), (3, 1)], "item long, cited long")
    triples = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (3, 4, 0), (4, 5, 0), (2, 5, 0), (1, 99, 0), (3, 1, 0)], "a long, b long, c long")
    got = {(r["a"], r["b"]): r["reason"] for r in pairs.link_reasons(triples, edges, files).collect()}
    assert got == {(1, 2): "co-cited", (1, 3): "same file", (3, 1): "same file", (3, 4): "one file uses both", (4, 5): "files use each other", (2, 5): "kept", (1, 99): "kept"}


def test_greedy_choices(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (2, 4)], "u int, v int")
    got = {(r["u"], r["v"]) for r in greedy.matching(e).collect()}
    assert got == {(1, 2), (4, 5)}
    c = spark.createDataFrame([("x", 1, 2, 9.0), ("x", 1, 3, 8.0), ("x", 1, 4, 7.0), ("y", 1, 2, 9.0), ("y", 5, 6, 1.0)], "arm string, u int, v int, score double")
    got = {(r["arm"], r["u"], r["v"]) for r in greedy.fill(c, ["x", "y"], 3).collect()}
    assert got == {("x", 1, 2), ("x", 1, 3), ("y", 5, 6)}
    b = greedy.batches(spark.createDataFrame([(i, n) for i, n in enumerate([5, 6, 7, 4, 5])], "id int, n int"), "id", "n", 64, 12).collect()
    size = {}
    for r in b:
        size.setdefault(r["batch"], []).append([5, 6, 7, 4, 5][r["id"]])
    assert all(len(x) * max(x) <= 12 or len(x) == 1 for x in size.values()) and len(b) == 5


def test_knn_breaks_ties_by_id(spark):
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], i % 2) for i, a in enumerate([0, 0.1, -0.1, 1.0, 3.0])]
    x = vec.unit_rows(spark.createDataFrame(rows, "id int, v array<double>, area int").withColumn("id", F.col("id").cast("long")), "id", "v", "area")
    for blocks in (1, 3):
        got = [(r["query"], r["id"]) for r in vec.knn(x, x.filter("id = 0"), 2, ["area"], blocks).orderBy("rank").collect()]
        assert got == [(0, 1), (0, 2)]
        h = vec.angle_histogram(x, "area", 10.0, blocks).agg(F.sum("pairs"), F.sum("same")).first()
        assert tuple(h) == (10, 4)


def test_models_recover_planted_effects(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 3000))
    n = rng.poisson(np.exp(0.5 - 0.3 * a + 0.2 * b + 0.25 * a * b))
    x = spark.createDataFrame([(float(p), float(q), float(p * q), int(k)) for p, q, k in zip(a, b, n, strict=True)], "a double, b double, ab double, n int")
    got = models.poisson(x, ["a", "b", "ab"], "n")
    scale = models.moments(x, ["ab"])["ab"][1]
    assert got["b"] == pytest.approx(0.2, abs=0.08) and got["ab"] / scale == pytest.approx(0.25, abs=0.08)
    y = x.withColumn("y", F.col("a") + 0.3 * F.rand(1) > 0.1).withColumn("g", (F.col("n") % 7).cast("string"))
    from tessera.operators.rank import auc

    assert auc(models.out_of_fold(y, ["a", "b"], "y", "g"), "score", "y").first()["auc"] > 0.95


def test_encoders_run_once_for_each_text(spark):
    from tessera.operators import encode

    x = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "ab"), (4, None)], "id int, text string")
    got = {r["id"]: r["v"] for r in encode.encoded(x, "id", "text", lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()}
    assert got == {1: [2.0, 1.0], 2: [3.0, 1.0], 3: [2.0, 1.0]}
    v = spark.createDataFrame(list(got.items()), "id int, v array<double>")
    p = spark.createDataFrame([(1, 2), (1, 3)], "i int, j int")
    assert {(r["i"], r["j"]): r["score"] for r in encode.scored(p, v, lambda a, b: (a * b).sum(1)).collect()} == {(1, 2): 7.0, (1, 3): 5.0}


def test_ranking_change_counts_strict_reversals_only(spark):
    from tessera.operators import encode

    a = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.1), ("q", 3, 0.5)], "anchor string, id int, distance double")
    b = spark.createDataFrame([("q", 1, 0.3), ("q", 2, 0.1), ("q", 3, 0.5)], "anchor string, id int, distance double")
    r = encode.ranking_change(a, b).first()
    assert (r["changed"], r["reversed"]) == (True, 0)


def test_line_spans(spark):
    from tessera.sources import records

    src = spark.createDataFrame([("f", "one\ntwo\nthree\nfour")], "file string, text string")
    r = spark.createDataFrame([("f", "x", 2, 3)], "file string, name string, first int, last int")
    assert records.line_spans(r, src).first()["body"] == "two\nthree"


def test_matching_in_rounds_equals_one_pass(spark):
    rng = random.Random(7)
    for n, m in ((12, 20), (60, 400), (5, 3)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        deg = {}
        for u, v in edges:
            if u != v:
                deg[u], deg[v] = deg.get(u, 0) + 1, deg.get(v, 0) + 1
        used, want = set(), set()
        for _, u, v in sorted((deg[u] + deg[v], u, v) for u, v in edges if u != v):
            if u not in used and v not in used:
                used |= {u, v}
                want.add((u, v))
        assert {(r["u"], r["v"]) for r in greedy.matching(spark.createDataFrame(edges, "u long, v long")).collect()} == want


def test_fill_reaches_candidates_however_far_down(spark):
    # a hub takes the first places of both arms far beyond the length of a list
    rows = [(arm, 0, k, 1000.0 - k) for arm in "xy" for k in range(1, 60)] + [(arm, 100 + k, 200 + k, float(-k)) for arm in "xy" for k in range(5)]
    got = [(r["arm"], r["u"], r["v"]) for r in greedy.fill(spark.createDataFrame(rows, "arm string, u long, v long, score double"), ["x", "y"], 4).orderBy("arm", "place").collect()]
    count, taken, want = {}, set(), []
    for arm in "xy":
        n = 0
        for _, u, v, _ in sorted((r for r in rows if r[0] == arm), key=lambda r: (-r[3], r[1], r[2])):
            if n < 4 and (u, v) not in taken and count.get(u, 0) < 2 and count.get(v, 0) < 2:
                taken.add((u, v))
                count[u], count[v] = count.get(u, 0) + 1, count.get(v, 0) + 1
                want.append((arm, u, v))
                n += 1
    assert got == want and len(got) == 7


def test_negatives_come_from_all_papers_of_an_area(spark):
    cit = [(p, w, p % 2, 2000) for p in range(60) for w in range(3) if (p * 7 + w) % 5 < 4 or w == 2]
    cit = [c for c in cit if not (c[1] == 2 and c[2] == 1 and c[0] != 59)]  # work 2: all of area 0, one of area 1
    table = spark.createDataFrame(cit, "paper long, work long, area long, year int")
    anchors = [(w, a, h) for w in range(3) for a in (3, 4) for h in (0, 1)]
    got = {(r["work"], r["anchor"], r["home"]): r["negative"] for r in grid.negatives(spark.createDataFrame(anchors, "work long, anchor long, home long"), table).collect()}
    for w, a, h in anchors:
        fit = {p for p, _, area, _ in cit if area == h} - {p for p, x, _, _ in cit if x == w}
        assert (w, a, h) in got if fit else (w, a, h) not in got
        assert not fit or got[w, a, h] in fit
    assert (2, 3, 0) not in got and len(set(got.values())) > 3


def test_outermost_with_repeated_spans(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), n, s, s + rng.randrange(6)) for n in range(80) for s in [rng.randrange(12)]]
    want = {r for r in rows if not any(o[0] == r[0] and o[1] != r[1] and o[2] <= r[2] and o[3] >= r[3] and (o[2:] != r[2:] or o[1] < r[1]) for o in rows)}
    assert {tuple(r) for r in pairs.outermost(spark.createDataFrame(rows, "k int, n int, s int, e int"), "k", "s", "e", "n").collect()} == want

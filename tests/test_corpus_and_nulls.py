"""Dense numbers, assembled corpora, all-pairs histograms, nulls of pairs, greedy batches and regression draws."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators import corpus as cp
from tessera.operators import dictionary as dic
from tessera.operators import greedy, models, nulls, pairs, resample


def test_numbers_follow_the_keys_alone(spark):
    values = [f"k{i * 37 % 501}" for i in range(900)] + [None]
    want = {k: n for n, k in enumerate(sorted(set(values) - {None}))}
    for parts in (1, 7):
        df = spark.createDataFrame([(v,) for v in values], "key string").repartition(parts)
        assert {r["key"]: r["idx"] for r in dic.dictionary(df, "key").collect()} == want
    assert dic.dictionary(df.limit(0), "key").count() == 0
    codes = dic.dictionary(df.filter("key <> 'k3'"), "key")
    with pytest.raises(Exception, match="unknown key: k3"):
        dic.encoded(df, "key", codes).collect()
    assert dic.encoded(df, "key", codes, closed=False).filter("idx IS NULL").select("key").distinct().count() == 2


def items(n=90, seed=4):
    rng = random.Random(seed)
    vectors = [(f"n{k:03d}", [rng.gauss(0, 1) for _ in range(6)]) for k in range(n)]
    areas = [(f"n{k:03d}", rng.choice(["a", "b", "c"])) for k in range(n) if k % 10]
    vocab = [(f"n{k:03d}", f"t{rng.randint(0, 400) if rng.random() < 0.5 else rng.randint(0, 12)}") for k in range(n + 5) for _ in range(20) if k % 7]
    rare = [(f"n{k:03d}", rng.randint(0, 60)) for k in range(n) for _ in range(3)]
    flags = [(f"n{k:03d}", k % 3 == 0, k % 5 == 0) for k in range(n) if k % 4]
    return vectors, areas, vocab, rare, flags


def frames(spark, data, parts=3):
    kinds = ("name string, vec array<double>", "name string, area string", "name string, key string", "name string, key int", "name string, observed boolean, fresh boolean")
    return [spark.createDataFrame(x, k).repartition(parts) for x, k in zip(data, kinds, strict=True)]


def brute(data, width, low=0.05):
    vectors, areas, vocab, rare, flags = data
    names = [n for n, _ in vectors]
    u = {n: np.array(x) / np.linalg.norm(x) for n, x in vectors}
    area, flag = dict(areas), {n: (o, f) for n, o, f in flags}
    voc, few = ({n: {k for m, k in t if m == n} for n in names} for t in (vocab, rare))
    df = {k: sum(k in few[n] for n in names) for _, k in rare}
    few = {n: {k for k in s if 2 <= df[k] <= 200} for n, s in few.items()}
    feat, hist = {}, {}
    for i, j in itertools.combinations(range(len(names)), 2):
        a, b = names[i], names[j]
        angle = round(float(np.degrees(np.arccos(np.clip(u[a] @ u[b], -1, 1)))), 6)
        union = len(voc[a] | voc[b])
        e, c = not few[a] & few[b], area.get(a, "") != area.get(b, "")
        s = (len(voc[a] & voc[b]) / union if union else 0) < low
        (oa, fa), (ob, fb) = flag.get(a, (False, False)), flag.get(b, (False, False))
        feat[i, j] = (int(angle // width), e, e and c, e and s, e and c and s)
        for name, ok in zip(cp.SUBSETS, feat[i, j][1:], strict=True):
            if ok:
                key = (name, 2 - oa - ob, fa or fb, feat[i, j][0])
                hist[key] = hist.get(key, 0) + 1
    return feat, hist


def test_walk_and_features_equal_brute_force(spark):
    data = items()
    corpus = cp.assemble(*frames(spark, data))
    feat, hist = brute(data, 5.0)
    for block in (1000, 17):
        got = {(r["subset"], r["kind"], r["fresh"], r["bin"]): r["n"] for r in cp.walk(corpus, 5.0, block=block).collect()}
        assert got == hist
    pairs = spark.createDataFrame([p for k, p in enumerate(feat) if k % 3 == 0], "i long, j long")
    for r in cp.pair_features(corpus, pairs, 5.0).collect():
        assert (r["bin"], r["eligible"], r["cross"], r["low"], r["hard"]) == feat[r["i"], r["j"]]
    same = cp.assemble(*frames(spark, data, 8))
    columns = ["idx", "name", "area", "rare", "vocab", "observed", "fresh"]
    assert corpus.select(*columns).orderBy("idx").collect() == same.select(*columns).orderBy("idx").collect()


@pytest.mark.parametrize("size", [40, 3])
def test_overlaps_by_dense_columns_and_by_spelling_out(monkeypatch, size):
    monkeypatch.setattr(blocks, "DENSE", 400)
    monkeypatch.setattr(blocks, "SPELLED", 7)
    rng = np.random.default_rng(size)
    a, b = ([np.unique(rng.integers(0, 50, rng.integers(0, size))) for _ in range(n)] for n in (23, 31))
    assert (blocks.overlaps(a, b) == [[len(set(x) & set(y)) for y in b] for x in a]).all()
    assert blocks.overlaps([np.array([], int)], b).sum() == 0


def test_groups_hold_enough_and_not_too_much():
    assert blocks.group_count(0, 8) == 1 and blocks.group_count(200, 8) == 1 and blocks.group_count(2000, 8) == 6 and blocks.group_count(10**6, 8) == 62
    assert blocks.group_count(10**9, 4000) == -(-(10**9) // blocks.GROUP)


def test_jaccard_of_given_pairs_over_groups(spark):
    rng = random.Random(7)
    held = {k: {rng.randint(0, 60) for _ in range(rng.randint(1, 25))} for k in range(900)}
    frame = spark.createDataFrame([(k, f"t{x}") for k, s in held.items() for x in s], "item long, key string")
    asked = {tuple(sorted(rng.sample(range(900), 2))) for _ in range(3000)}
    got = {(r["i"], r["j"]): (r["overlap"], r["jaccard"]) for r in pairs.jaccard_of(spark.createDataFrame(sorted(asked) + [(1, 5000)], "i long, j long"), frame).collect()}
    assert set(got) == asked
    assert all(v == (len(held[i] & held[j]), len(held[i] & held[j]) / len(held[i] | held[j])) for (i, j), v in got.items())


def test_assembly_fails_closed(spark):
    data = list(items(12))
    with pytest.raises(Exception, match="several areas"):
        cp.assemble(*frames(spark, [data[0], [*data[1], ("n001", "z")], *data[2:]]))
    with pytest.raises(Exception, match="several vectors"):
        cp.assemble(*frames(spark, [data[0] + data[0][:1], *data[1:]]))
    with pytest.raises(Exception, match="no direction"):
        cp.assemble(*frames(spark, [[*data[0], ("z", [0.0] * 6)], *data[1:]]))
    corpus = cp.assemble(*frames(spark, data))
    known = spark.createDataFrame([("n001", "n002"), ("n001", "gone"), ("n003", "n003")], "a string, b string")
    assert cp.truth(corpus, known).count() <= 1


def test_null_auc_needs_no_order(spark):
    """The sum of places gives what counting each pair against the rest of the population does."""
    rng = random.Random(2)
    hist = {b: rng.randint(0, 30) for b in range(20)}
    bins = [rng.randint(0, 19) for _ in range(25)]
    hist = {b: n + bins.count(b) for b, n in hist.items() if n + bins.count(b)}
    rest = [b for b, n in hist.items() for _ in range(n - bins.count(b))]
    want = np.mean([(r > b) + 0.5 * (r == b) for b in bins for r in rest])
    pop = nulls.population(spark.createDataFrame(list(hist.items()), "bin long, n long"))
    got = nulls.observed(spark.createDataFrame([(0, k, b) for k, b in enumerate(bins)], "i long, j long, bin long"), pop).first()
    assert got["k"] == 25 and got["auc"] == pytest.approx(want)


def test_permutation_in_classes_is_that_of_one_order(spark):
    points = spark.range(0, 500, 5).select(F.col("id").alias("e"))
    a, b = (sorted(map(tuple, nulls.permutation(points, 3, "s", size).collect())) for size in (1 << 16, 9))
    assert a == b and len(a) == 300
    for draw in range(3):
        to = [t for d, _, t in a if d == draw]
        assert sorted(to) == list(range(0, 500, 5)) and to != sorted(to)


def test_drawn_pairs_keep_the_wiring(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (2, 3)], "i long, j long")
    for drawn in (nulls.substituted(pairs, 1000, 4, "x"), nulls.permuted(pairs, 4, "x")):
        for draw in range(4):
            got = [(r["i"], r["j"]) for r in drawn.collect() if r["draw"] == draw]
            degree = sorted(sum(e in p for p in got) for e in {x for p in got for x in p})
            assert all(i < j for i, j in got) and degree == [1, 2, 2, 3]
    assert {tuple(r) for r in nulls.without(pairs, nulls.hubs(pairs, 0.75)).collect()} == {(2, 3)}


def test_independent_pairs_follow_the_population(spark):
    pop = nulls.population(spark.createDataFrame([(0, 100), (3, 300), (7, 600)], "bin long, n long"))
    sizes = spark.createDataFrame([(d, 200) for d in range(60)], "draw long, k long")
    auc = np.array([r["auc"] for r in nulls.independent(sizes, pop, "i").collect()])
    assert len(auc) == 60 and abs(auc.mean() - 0.5) < 0.01 and 0.005 < auc.std() < 0.05


def sequential(rows, limit, tokens):
    out, batch, n = {}, -1, 0
    for length, key in sorted((l or 0, k) for k, l in rows):
        if batch < 0 or n >= limit or (n + 1) * length > tokens:
            batch, n = batch + 1, 0
        out[key], n = batch, n + 1
    return out


@pytest.mark.parametrize(("limit", "tokens"), [(64, 8192), (7, 100), (1, 5), (500, 20_000)])
def test_batches_equal_one_pass(spark, limit, tokens):
    rng = random.Random(limit)
    rows = [(k, rng.choice([None, 0, 1, 3, int(rng.expovariate(0.01)), 9000])) for k in range(100_000 if limit == 64 else 3000)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = {r["id"]: r["batch"] for r in greedy.batches(df, "id", "n", limit, tokens).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sequential(rows, limit, tokens)


def test_batches_of_the_reference_rule(spark):
    df = spark.createDataFrame([(k, 100 + k) for k in range(400)], "id long, n long")
    got = greedy.batches(df, "id", "n", 64, 32_768).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [64, 64, 64, 64, 64, 64, 16]
    assert greedy.batches(df.limit(0), "id", "n", 64, 32_768).count() == 0


def single(x, y, times):
    """One Poisson fit with row weights."""
    z = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(z.shape[1])
    beta[0] = np.log((times * y).sum() / times.sum())
    for _ in range(100):
        mu = np.exp(z @ beta)
        step = np.linalg.solve((z * (times * mu)[:, None]).T @ z, z.T @ (times * (y - mu)))
        beta += step
        if np.abs(step).max() < 1e-13:
            break
    return beta


def test_regression_draws_equal_single_fits(spark):
    rng = np.random.default_rng(6)
    n = 600
    g, a = rng.integers(0, 40, n), rng.integers(0, 3, n)
    x = rng.normal(size=(n, 2))
    y = rng.poisson(np.exp(0.3 + 0.5 * x[:, 0] - 0.2 * x[:, 1] + 0.4 * (a == 2)))
    rows = [(int(g[i]), int(a[i]), float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(n)]
    df, areas = models.one_hot(spark.createDataFrame(rows, "work long, area long, s double, m double, n long").repartition(5), "area", 3)
    terms = ["s", "m", *areas]
    got = {}
    for r in models.poisson_draws(df, terms, "n", "work", 6, "boot").collect():
        got.setdefault(r["draw"], {})[r["term"]] = r["coefficient"]
    groups = resample.numbered(df, "work")
    mult = {(r["draw"], r["work"]): r["mult"] for r in resample.multiplicities(groups, "work", 6, "boot").collect()}
    design = np.column_stack([x, a == 1, a == 2])
    for d in range(6):
        want = single(design, y, np.array([mult.get((d, int(k)), 0) for k in g], float))
        assert [got[d][t] for t in ["intercept", *terms]] == pytest.approx(want, abs=1e-6)

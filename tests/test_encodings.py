"""Pooling over windows, reranking, projections and layouts on the sphere, against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, layout, vectors


def frame(spark, x):
    return spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "id long, u array<double>")


def units(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pooled_windows_equal_the_mean_over_all_tokens(spark):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(256, 6))  # a linear stand-in: a token's own vector
    texts = ["a", "some words " * 40, "é" * 300, "x" * 1000, None, "short one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    calls = lambda w: np.stack([table[x].mean(0) for x in w])
    got = {r["id"]: r["v"] for r in encode.pooled(df, "id", "text", lambda t: list(t.encode()), calls, window=32, batch=5).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    for k, v in got.items():
        mean = table[list(texts[k].encode())].mean(0)
        assert v == pytest.approx(mean / np.linalg.norm(mean))
    with pytest.raises(Exception, match="no tokens"):
        encode.pooled(spark.createDataFrame([(0, "")], "id long, text string"), "id", "text", lambda t: list(t.encode()), calls).collect()


def average_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_reranked_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 120)
    x = units(500, 8, 2)
    rng = np.random.default_rng(3)
    chosen = rng.choice(500 * 499 // 2, 900, replace=False)
    i, j = (a[chosen] for a in np.triu_indices(500, 1))
    score = rng.integers(0, 40, 900).astype(float)

    def between(a, b):
        m = a + b
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    pairs = spark.createDataFrame([(int(a), int(b), float(s)) for a, b, s in zip(i, j, score, strict=True)], "i long, j long, score double")
    got = {(r["i"], r["j"]): r for r in encode.reranked(pairs, frame(spark, x), between, top=300).collect()}
    order = sorted(range(900), key=lambda k: (-score[k], i[k], j[k]))[:300]
    i, j, score = i[order], j[order], score[order]
    p = between(x[i], x[j])
    sim = p @ x.T
    sim[np.arange(300), i] = sim[np.arange(300), j] = -2
    novelty, reach = np.round(1 - sim.max(1), 9), np.round(1 - np.maximum((p * x[i]).sum(1), (p * x[j]).sum(1)), 9)
    novel = (average_ranks(score) + average_ranks(novelty) + average_ranks(reach)) / 3
    assert len(got) == 300
    for k in range(300):
        r = got[int(i[k]), int(j[k])]
        assert (r["score"], r["novelty"], r["reach"]) == (score[k], pytest.approx(novelty[k], abs=1e-8), pytest.approx(reach[k], abs=1e-8))
        assert r["novel"] == pytest.approx(novel[k], abs=0.4)


def test_largest_breaks_ties_by_column():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 6, (200, 30)).astype(float)
    s[:100] = rng.random((100, 30))
    for k in (1, 4, 30, 40):
        assert (vectors.largest(s, k) == np.argsort(-s, axis=1, kind="stable")[:, :k]).all()


def projected(x):
    z = x - x.mean(0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:3]
    axes = axes * np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    p = z @ axes.T
    n = np.linalg.norm(p, axis=1)
    return p / n[:, None], n**2 / (z**2).sum(1)


def test_sphere_equals_svd(spark):
    x = units(300, 9, 6) * [3, 2, 1.5, 1, 1, 1, 1, 1, 1]
    at, fidelity = projected(x)
    got = sorted(layout.sphere(frame(spark, x).repartition(5)).collect())
    assert np.allclose([r[1:4] for r in got], at, atol=1e-8) and np.allclose([r["fidelity"] for r in got], fidelity, atol=1e-8)
    assert layout.sphere(frame(spark, x).limit(0)).count() == 0
    same = layout.sphere(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert all(r["x"] is None and r["fidelity"] is None for r in same)


def kept(at, near, k):
    sim = at @ at.T
    np.fill_diagonal(sim, -2)
    top = np.argsort(-sim, axis=1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(top, near, strict=True)])


def test_layout_keeps_more_neighbours_than_the_projection(spark):
    rng = np.random.default_rng(7)
    centre = units(12, 10, 8)
    x = centre[rng.integers(0, 12, 150)] + rng.normal(scale=0.25, size=(150, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, x)
    near = vectors.knn(rows, rows, 5)
    start = layout.sphere(rows)
    end = layout.layout(start, near.select("query", "id"), 5, epochs=12, rate=0.4, repel=0.05)
    true = [[r["id"] for r in sorted(g, key=lambda r: r["rank"])] for g in ([r for r in near.collect() if r["query"] == q] for q in range(150))]
    place = lambda df: np.array([(r["x"], r["y"], r["z"]) for r in df.orderBy("id").collect()])
    before, after = kept(place(start), true, 5), kept(place(end), true, 5)
    assert np.allclose(np.linalg.norm(place(end), axis=1), 1) and after > before + 0.1, (before, after)
    again = layout.layout(start.repartition(7), near.select("query", "id"), 5, epochs=2)
    assert np.allclose(place(again), place(layout.layout(start, near.select("query", "id"), 5, epochs=2)))
    assert layout.layout(start, near.select("query", "id"), 5, epochs=50, still=10.0).filter(F.col("x").isNotNull()).count() == 150

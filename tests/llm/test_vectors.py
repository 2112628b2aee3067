"""The vector operators against brute force, with copies, ties and unusable rows."""

import numpy as np

from tessera.llm import ego_join, lsh_search

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def rows(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:80] = x[20:50] + rng.normal(scale=0.08, size=(30, dim)).astype(np.float32)
    x[80:120] = x[3] + rng.normal(scale=0.1, size=(40, dim)).astype(np.float32)
    x[120:170] = x[7]
    out = [(i, [float(v) for v in r], 0, "x") for i, r in enumerate(x)]
    out += [(900, None, 0, "x"), (901, [0.0] * dim, 0, "x"), (902, [float("nan")] * dim, 0, "x"), (903, [None] + [1.0] * (dim - 1), 0, "x"), (904, [float("inf")] * dim, 0, "x"), (950, [], 0, "x")]
    return x, out


def test_grid_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK", 32)
    monkeypatch.setattr(ego_join, "LEAF", 8)
    monkeypatch.setattr(ego_join, "FAN", 2)
    x, data = rows()
    got = {r["vec_id"]: r for r in ego_join.near_vectors(spark.createDataFrame(data + data[:3], SCHEMA)).collect()}
    y = x.astype(float)
    n = np.sqrt((y * y).sum(1))
    link = (y @ y.T) / (n[:, None] * n[None]) >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(link, label[None], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), label[i], label[i] == i)
    for i in (900, 901, 902, 903, 904, 950):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_parts_of_blocks_give_every_link_once(monkeypatch):
    """Dense and sparse blocks, and pairs at the threshold, against the plain formula over all pairs."""
    monkeypatch.setattr(ego_join, "LEAF", 16)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(70, 12)), rng.normal(size=(1, 12)) + rng.normal(scale=0.05, size=(90, 12))])
    flat = np.zeros((2, 12))
    flat[0, 0], flat[1, :2] = 1, (0.95, np.sqrt(1 - 0.95**2))
    x = np.concatenate([x, flat])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = u[:, :4]
    eps = np.sqrt(2 - 2 * 0.95) + 1e-9
    want = ego_join.vectors.cosine(x[:, None], x[None]) >= 0.95
    got = np.zeros_like(want)
    for a, b, linked in ego_join.join(x, u, p, x, u, p, 0.95, eps, True):
        part = got[a : a + linked.shape[0], b : b + linked.shape[1]]
        assert not (part & linked).any()
        part |= linked
    assert (got == np.triu(want, 1)).all() and got.sum() > 3000
    got = np.zeros((100, 62), bool)
    for a, b, linked in ego_join.join(x[:100], u[:100], p[:100], x[100:], u[100:], p[100:], 0.95, eps, False):
        got[a : a + linked.shape[0], b : b + linked.shape[1]] |= linked
    assert (got == want[:100, 100:]).all()


def test_blocks_are_sized_by_bytes():
    assert ego_join.block_rows(64) == 4096 and ego_join.block_rows(2) == 4096
    assert all(8 * d * ego_join.block_rows(d) <= ego_join.BYTES for d in (64, 768, 4096, 100_000))


def test_search_recall_scores_and_ties(spark):
    x, data = rows(n=600)
    got = {}
    for r in lsh_search.search(spark.createDataFrame(data, SCHEMA), every=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(float)
    n = np.sqrt((y * y).sum(1))
    hits = total = 0
    for q in range(0, 600, 10):
        s = (y @ y[q]) / (n * n[q])
        s[q] = -2
        top = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and q not in {v for _, v, _ in mine}
        assert all(abs(c - s[v]) < 1e-12 for _, v, c in mine)
        hits += len(set(top) & {v for _, v, _ in mine})
        total += 5
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[120])] == [7, 121, 122, 123, 124]
    assert 900 not in got and 950 not in got


def test_few_candidates_and_empty_tables(spark):
    some = spark.createDataFrame([(0, [1.0, 0.0], 0, "x"), (1, [1.0, 0.1], 0, "x"), (2, None, 0, "x")], SCHEMA)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in lsh_search.search(some).collect()] == [(0, 1, 1)]
    none = spark.createDataFrame([], SCHEMA)
    assert lsh_search.search(none).count() == 0 and ego_join.near_vectors(none).count() == 0


def test_lone_queries_are_searched_exactly(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 64))  # 5 candidates each, of which the buckets visited hold some
    data = [(i, [float(c) for c in v], 0, "x") for i, v in enumerate(x)]
    data.append((3, [float(c) for c in -x[3] + x[0] / 9], 0, "x"))  # a vec_id with two vectors fills one rank
    got = lsh_search.search(spark.createDataFrame(data, SCHEMA), every=1).collect()
    unit = {i: [np.array(v) / np.linalg.norm(v) for k, v, *_ in data if k == i] for i in range(6)}
    for q in (0, 1, 2, 4, 5):
        near = sorted(((-max(float(unit[q][0] @ v) for v in unit[i]), i) for i in range(6) if i != q))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in near]


def test_recall_on_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows_ = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows_]), np.array([r["embedding"] for r in rows_], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in lsh_search.search(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))][:6]) - {q})
    assert hits >= 0.9 * 5 * len(got)


def test_perturbations_come_in_order_of_success():
    frac = np.array([0.1, 0.5, 0.8])
    steps = lsh_search.perturbations(frac, 12)
    cost = [sum((f if s < 0 else 1 - f) ** 2 for f, s in zip(frac, x, strict=True) if s) for x in steps]
    assert (steps[0] == 0).all() and cost == sorted(cost) and len({tuple(s) for s in steps}) == 12

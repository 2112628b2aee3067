"""Bridges between items: by pairs of keys, and within the tasks of two groups; against all triples."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bridges, pairs


def brute(held, area, cap, cited=frozenset()):
    df = {}
    for s in held.values():
        for k in s:
            df[k] = df.get(k, 0) + 1
    rare = {i: {k for k in s if df[k] > 1} for i, s in held.items()}
    out = {}
    for c in sorted(held):
        near = [(round(sum(1 / df[k] for k in rare[c] & rare[x]), 9), x) for x in held if x != c and len(rare[c] & rare[x]) >= 2]
        near = sorted(near, reverse=True)[:cap]
        for wa, a in near:
            for wb, b in near:
                linked = {(a, b), (b, a), (a, c), (c, a), (b, c), (c, b)} & cited
                if a < b and len({area[a], area[b], area[c]}) == 3 and not rare[a] & rare[b] and not linked:
                    out.setdefault((a, b), (c, min(wa, wb)))
    return out


def frames(spark, held, area, kind="long"):
    items = spark.createDataFrame([(i, k) for i, s in held.items() for k in s], f"item {kind}, key string")
    return pairs.rare(items), spark.createDataFrame(list(area.items()), f"item {kind}, area string")


def made():
    """Items of few keys each: both keys of one theme, or of two."""
    rng = random.Random(4)
    held = {i: {f"{t}{z}" for t in rng.sample(range(20), rng.randint(1, 2)) for z in "xy"} for i in range(120)}
    return held, {i: f"area {i % 5}" for i in held}


def result(df):
    return {(r["a"], r["b"]): (r["c"], pytest.approx(r["score"], abs=2e-9)) for r in df.collect()}


@pytest.mark.parametrize(("kind", "name"), [("long", lambda i: i), ("string", lambda i: f"i{i}")])
def test_bridges_within_tasks_equal_all_triples(spark, kind, name):
    rng = random.Random(6)
    held = {name(i): {f"k{rng.randint(0, 700)}" for _ in range(9)} | {f"g{i // 4 % 25}-{j}" for j in range(2)} | {f"h{i % 31}-{j}" for j in range(20)} for i in range(120)}
    area = {i: f"area {k % 5}" for k, i in enumerate(held)}
    rare, areas = frames(spark, held, area, kind)
    want = brute(held, area, 6)
    assert len(want) > 50
    sets, starts, dfs = bridges.key_sets(rare)
    for groups, stripes in ((1, 1), (3, 2)):
        near = bridges.heaviest(sets, starts, dfs, 2, 6, groups, stripes)
        assert result(bridges.bridged(sets, near, areas, groups)) == want
    plan = bridges.bridged(sets, near, areas, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # no pair is a row of a shuffle


@pytest.mark.parametrize("cited", [frozenset(), frozenset((i, i + 1) for i in range(119)) | {(0, 7), (7, 0), (3, 90)}])
def test_bridges_by_pairs_of_keys_equal_all_triples(spark, cited):
    held, area = made()
    rare, areas = frames(spark, held, area)
    cites = spark.createDataFrame(sorted(cited), "item long, cited long") if cited else None
    assert bridges.few_keys(rare)
    want = brute(held, area, 150, cited)
    assert len(want) > 20 and result(pairs.bridge_triples(rare, areas, cites)) == want


def test_pairs_of_keys_make_fewer_rows_than_pairs_of_items(spark, monkeypatch):
    """Items that share one key never meet: 200 items hold a key, two of them a second one."""
    held = spark.createDataFrame([(i, "all", 200) for i in range(200)] + [(i, "two", 2) for i in (3, 9)], "item long, key string, df long")
    sizes = []
    monkeypatch.setattr(bridges, "settled", lambda df: sizes.append(df.count()) or df)
    got = {(r["c"], r["x"], r["shared"]) for r in bridges.by_key_pairs(held, 2).collect()}
    assert got == {(3, 9, 2), (9, 3, 2)} and max(sizes) == 2


def test_reasons_ask_for_the_files_of_the_pairs_alone(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "item long, cited long")
    files = spark.createDataFrame([(i, i // 2) for i in range(301)], "item long, file long")
    asked = spark.createDataFrame([(1, 3), (10, 11), (100, 200)], "a long, b long")
    sizes = []
    monkeypatch.setattr(pairs, "settled", lambda df: sizes.append(df.count()) or df)
    got = {(r["a"], r["b"]): r["reason"] for r in pairs.link_reasons(asked, edges, files).collect()}
    assert got == {(1, 3): "files use each other", (10, 11): "same file", (100, 200): "kept"}
    assert sorted(sizes)[-2] < 20  # the edges themselves aside

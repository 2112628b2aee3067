"""Ties, strata, weights, placements and quantiles, on toys and against brute force."""

import random

import pytest

from tessera.operators import rank
from tessera.operators import resample as rs


def brute(rows):
    won = n = 0.0
    for s, y, w in rows:
        for t, z, v in rows:
            if y and not z:
                n += w * v
                won += w * v * (1.0 if s > t else 0.5 if s == t else 0.0)
    return won / n if n else None


@pytest.mark.parametrize(("scores", "positive", "expected"), [([0.0] * 100, set(range(10)), 0.5), ([1, 1, 1, 2], {0}, 1 / 3), ([2, 1, 1, 1], {3}, 1 / 3), ([0, 1, 2], {2}, 1.0), ([0, 1], set(), None)])
def test_auc_averages_ties(spark, scores, positive, expected):
    x = spark.createDataFrame([(float(s), i in positive) for i, s in enumerate(scores)], "s double, y boolean")
    assert rank.auc(x, "s", "y").first()["auc"] == (pytest.approx(expected) if expected is not None else None)


def test_auc_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(30)), rng.random() < 0.3, float(rng.randrange(1, 4))) for _ in range(300)]
    x = spark.createDataFrame(rows, "s double, y boolean, w double")
    assert rank.auc(x, "s", "y", "w").first()["auc"] == pytest.approx(brute(rows))
    places = rank.placements(x, "s", "y").collect()
    mean = sum(r["placement"] * r["n"] for r in places) / sum(r["n"] for r in places)
    assert mean == pytest.approx(brute([(s, y, 1.0) for s, y, _ in rows]))


@pytest.mark.parametrize(("s", "y", "g", "expected"), [([0, 0, 1, 1, 1, 1], "FTTTTF", [0, 0, 1, 1, 1, 1], 0.5), ([0, 1, 1, 1, 1, 0], "FTFFFT", [0, 0, 1, 1, 1, 1], 0.25)])
def test_stratified_auc(spark, s, y, g, expected):
    x = spark.createDataFrame([(float(a), b == "T", c) for a, b, c in zip(s, y, g, strict=True)], "s double, y boolean, g int")
    assert rank.stratified_auc(x, "s", "y", "g").first()["auc"] == pytest.approx(expected)


def test_midranks_and_cumulative_are_whole(spark):
    rng = random.Random(2)
    values = [float(rng.randrange(200)) for _ in range(1000)]
    x = spark.createDataFrame(list(enumerate(values)), "id int, s double")
    got = {r["id"]: r["rank"] for r in rank.midranks(x, "s").collect()}
    for i in (0, 17, 500):
        below, same = sum(v < values[i] for v in values), sum(v == values[i] for v in values)
        assert got[i] == below + (same + 1) / 2


def test_holm_stops_at_the_first_that_stands(spark):
    x = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.02), ("d", 0.012)], "name string, p double")
    assert {r["name"] for r in rs.holm(x, "name", "p").collect() if r["rejected"]} == {"a", "d", "c", "b"}
    y = spark.createDataFrame([("a", 0.03), ("b", 0.001), ("c", 0.02)], "name string, p double")
    assert {r["name"]: r["rejected"] for r in rs.holm(y, "name", "p").collect()} == {"b": True, "c": True, "a": True}
    z = spark.createDataFrame([("a", 0.03), ("b", 0.03), ("c", 0.001)], "name string, p double")
    assert {r["name"]: r["rejected"] for r in rs.holm(z, "name", "p").collect()} == {"c": True, "a": False, "b": False}


def test_draws_keep_the_number_of_groups(spark):
    groups = rs.numbered(spark.createDataFrame([(c,) for c in "abcde"], "g string"), "g")
    m = rs.multiplicities(groups, "g", 20, "seed").groupBy("draw").sum("mult").collect()
    assert len(m) == 20 and all(r[1] == 5 for r in m)


def test_largest_remainder_fills_the_total(spark):
    x = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "g string, n int")
    got = {r["g"]: r["quota"] for r in rs.largest_remainder(x, "g", "n", 10).collect()}
    assert got == {"a": 4, "b": 3, "c": 3} and sum(got.values()) == 10


def test_quantile_bands(spark):
    x = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    got = {r["v"]: r["band"] for r in rank.quantile_band(x, "v", [0.2, 0.4, 0.6, 0.8]).collect()}
    assert got[0.0] == 0 and got[2.0] == 1 and got[10.0] == 4

"""Findings of round 4: what travels, what is broadcast, and what a task holds."""

import random

import pytest

from tessera import plans
from tessera.operators import meetings, nulls, pairs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(8)
    return spark.createDataFrame([(k, f"k{x}") for k in range(120) for x in {rng.randint(0, 90) for _ in range(6)}], "item long, key string")


def plan(df, of="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), of)().toString()


def test_f3_blocks_are_read_and_never_shuffled(items):
    for groups in (1, 5):
        assert "Exchange" not in plan(meetings.linked(items, 2, 9, groups=groups)[0], "executedPlan")


def test_f3_pairs_know_whether_their_areas_differ(spark, items):
    area = spark.createDataFrame([(k, None if k == 4 else f"a{k % 3}") for k in range(120) if k != 7], "item long, area string")
    plain = meetings.linked(items, 2, 9, columns=("shared",))[0].collect()
    got = meetings.linked(items, 2, 9, area, columns=("shared", "cross"), groups=4)[0].collect()
    known = lambda i, j: not {4, 7} & {i, j} and i % 3 != j % 3
    assert sorted(map(tuple, got)) == sorted((r["i"], r["j"], r["shared"], int(known(r["i"], r["j"]))) for r in plain) and {r["cross"] for r in got} == {0, 1}


def test_f3_pair_subsets_joins_no_pairs(spark):
    assert "Join" not in plan(plans.QUERIES["pair_subsets"](spark, SMALL))


def test_f1_far_pairs_travel_without_their_hashes(spark, items):
    area = spark.createDataFrame([(k, f"a{k % 3}") for k in range(120)], "item long, area string")
    text = plan(pairs.far_pairs(items, area, 9, 0.9, 2))
    assert text.index("sha2") < text.index("RepartitionByExpression")


def test_f1_a_task_spells_out_few_pairs_at_once():
    assert meetings.SPELLED <= 1 << 20 and 8 * meetings.BLOCK <= meetings.GROUP


def test_f2_draws_are_never_broadcast(spark):
    given = spark.createDataFrame([(k, k + 1 + k % 3) for k in range(60)], "i long, j long").repartition(3)
    labelled = spark.createDataFrame([(k, float(k % 9), k % 4 == 0) for k in range(60)], "id long, s double, y boolean")
    for df in (nulls.permuted(given, 5, "p"), nulls.label_permutation(labelled, 5, "p")):
        lines = plan(df, "executedPlan").split("\n")
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                assert "draw" not in lines[at + 1], lines[at + 1]

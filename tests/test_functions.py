"""Exact tests, truth tables, states and name boundaries."""

import numpy as np
import pytest

from tessera.functions import formal, numbers, stats


def test_exact_tests():
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503497)
    assert stats.binomial_sign(8, 10) == pytest.approx(0.109375) and stats.binomial_sign(0, 0) == 1.0
    assert stats.poisson_sf(3, 1.0) == pytest.approx(0.0803013971) and stats.poisson_sf(0, 2) == 1.0


def test_truth_tables():
    same = lambda a, b: np.array_equal(formal.truth_table(a), formal.truth_table(b))
    assert same("p0 → p1", "¬p0 ∨ p1") and same("p0 → p1 → p2", "p0 → (p1 → p2)") and not same("p0 → p1 → p2", "(p0 → p1) → p2")
    assert same("p0 ∧ p1 ∨ p2", "(p0 ∧ p1) ∨ p2") and formal.truth_table("p0 ∨ ¬p0").all() and not formal.truth_table("False").any()
    for bad in ("p0 ∧", "(p0", "p0 p1", "p8", "Z", ""):
        with pytest.raises(ValueError):
            formal.truth_table(bad)


def test_states_and_names(spark):
    state = "x : ℕ\nh : x  > 0\n⊢ x ≠ 0"
    assert formal.content_view(state, "goal") == "x ≠ 0" and formal.content_view(state, "hypotheses") == "x : ℕ\nh : x > 0"
    assert formal.state_parts("no goals") == {"hypotheses": ["no goals"], "goal": []}
    x = spark.createDataFrame([("use foo.bar here",), ("foo.bar'",), ("foo.bar.baz",), ("x.foo.bar",), ("(foo.bar).",), ("by foo.bar. Then",)], "t string")
    assert [r[0] for r in x.select(formal.whole_name("t", "foo.bar")).collect()] == [True, False, False, False, True, False]


def test_rounding_sql():
    assert numbers.rounded_sql("select round(sum(a) / max(round(b, 2)), 6) x") == "select round((sum(a) / max(round((b) + 1e-12::double, 2))) + 1e-12::double, 6) x"

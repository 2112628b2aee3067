"""Drawn negatives, far training sets, concepts of states, token limits, axiom reports and replay identities."""

import hashlib

import pytest

from tessera.functions import formal
from tessera.operators import certify, training


def test_concepts_of_a_state():
    state = "α : Type u_1\ninst✝ : Group α\nf g : α → Monoid.Hom α\nh : f.comp g = Set.univ.\n  indented g.map tail\n⊢ ∀ x, h.1 ∈ Filter.atTop ∧ True"
    assert formal.concepts(state) == {"→", "Monoid.Hom", "comp", "1", "Set.univ", "indented", "map", "tail", "∀", "x", "∈", "Filter.atTop", "∧", "True"}
    assert formal.concepts("") == set() and formal.concepts("⊢ Prop Sort v_2 w") == set()
    assert formal.concepts("a b : c") == {"c"} and formal.concepts(" : c") == {"c"}


def test_negatives_are_drawn_again(spark):
    """Every item but one is co-cited with item 0, so its rows hold that one or go."""
    n = 12
    sets = spark.createDataFrame([(r, [0, 1 + r % 11]) for r in range(200)] + [(900, [3])], "row long, items array<long>")
    a = training.anchors(sets, "s")
    got = a.collect()
    assert len(got) == 200 and all(sorted((r["a"], r["p"])) == [0, 1 + r["row"] % 11] for r in got) and 60 < sum(r["a"] == 0 for r in got) < 140
    degrees = spark.createDataFrame([(k, 1 + k) for k in range(n)], "item long, degree long")
    near = spark.createDataFrame([(q, (q + k) % n, k) for q in range(n) for k in range(1, 6)], "query long, id long, rank long")
    cocited = spark.createDataFrame([(0, k) for k in range(1, n) if k != 5], "i long, j long")
    rows = {r["row"]: r for r in training.negatives(a, degrees, near, cocited, "s", 5).collect()}
    zero = [r for r in rows.values() if r["a"] == 0]
    assert zero and all(r[k] == 5 for r in zero for k in training.KINDS)
    others = [r for r in rows.values() if r["a"] != 0]
    assert len(others) > 30 and all(r[k] != r["a"] and (r[k] != 0 or r["a"] == 5) for r in others for k in training.KINDS)
    cls = {r["item"]: r["class"] for r in training.popularity(degrees).collect()}
    assert all(cls[r["popular"]] == cls[r["p"]] for r in rows.values()) and all((r["look"] - r["a"]) % n in range(1, 6) for r in rows.values())


@pytest.mark.parametrize("most", [30, 1000])
def test_far_training_sets_are_nested_and_held_out(spark, most):
    items = [(i, f"k{k}") for k in range(40) for i in range(60) if (i * 7 + k * 3) % (4 + k % 9) == 0]
    df = {}
    for _, k in items:
        df[k] = df.get(k, 0) + 1
    rare = spark.createDataFrame([(i, k, df[k]) for i, k in items], "item long, key string, df long")
    area = spark.createDataFrame([(i, f"a{i % 3}") for i in range(60)], "item long, area string")
    held_by = {}
    for i, k in items:
        held_by.setdefault(i, set()).add(k)
    share = [(i, j, 0.01 if (i + j) % 4 else 0.5) for i in range(60) for j in range(i + 1, 60) if held_by.get(i, set()) & held_by.get(j, set())]
    jac = spark.createDataFrame(share, "i long, j long, jaccard double")
    got = training.far_training(rare, area, jac, (6, 60), "s", per_key=5, most=most).collect()
    sha = lambda *x: hashlib.sha256("|".join(map(str, x)).encode()).hexdigest()
    held = set(sorted(df, key=lambda k: sha("s", k))[: round(0.1 * len(df))])
    best = {(i, j): min((df[k], sha("s", k, i, j), k) for k in held_by[i] & held_by[j]) for i, j, v in share if v < 0.05 and i % 3 != j % 3}
    natural = {}
    for c in (6, 60):
        per = {}
        for p, (n, h, k) in best.items():
            if n <= c:
                per.setdefault(k, []).append((h, p))
        few = {k: sorted(x)[:5] for k, x in per.items()}
        natural[c] = sorted((h, p) for k, x in few.items() if k not in held for h, p in x)[:most]
        part = lambda name, c=c: {(r["i"], r["j"]) for r in got if r["cutoff"] == c and r["part"] == name}
        assert part("natural") == {p for _, p in natural[c]} and part("heldout") == {p for k, x in few.items() if k in held for _, p in x}
        assert part("equal") == {p for _, p in sorted(natural[c], key=lambda x: sha("equal", x[0]))[: len(natural[6])]}
    assert natural[6] and (len(natural[60]) > len(natural[6]) or most == 30)


def test_critical_records_must_fit(spark):
    x = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, n int")
    got = {r["id"]: r["fits"] for r in certify.fitting(x, "n", 10, x.filter("id = 1")).collect()}
    assert got == {1: True, 2: False, 3: False}
    for bad in ("id = 2", "id = 3"):
        with pytest.raises(certify.CheckError):
            certify.fitting(x, "n", 10, x.filter(bad))


def test_axioms_are_those_of_the_target_itself(spark):
    rows = [
        ("a", "'a' depends on axioms: [propext, Classical.choice]"), ("a", " 'a' depends on axioms: [Quot.sound] "), ("b", "'a' depends on axioms: [propext]"),
        ("b", "x 'b' depends on axioms: [propext]"), ("c", "'c' does not depend on any axioms"), ("d", "'d' depends on axioms: [sorryAx, propext]"), ("e", "'e' depends on axioms: [x] and [y]"), ("f", "'f' depends on axioms: []"),
    ]
    got = {r["target"]: (r["reports"], r["axioms"], r["outside"], r["accepted"]) for r in certify.target_axioms(spark.createDataFrame(rows, "target string, data string")).collect()}
    assert got["a"] == (2, ["Classical.choice", "Quot.sound", "propext"], [], True)
    assert got["b"][0] == 0 and not got["b"][3] and got["c"] == (1, [], [], True) and got["d"][2:] == (["sorryAx"], False) and not got["e"][3] and got["f"] == (1, [], [], True)


def test_replays_of_others_are_refused(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    records = spark.createDataFrame([("p", "mathlib:x", "body", "file"), ("q", "other:y", "two", "file")], "id string, theorem_id string, body string, source_artifact string")
    rows = [("p", "mathlib:x", sha("body"), "e", "file"), ("p", "mathlib:z", sha("else"), "e", "moved"), ("q", "other:y", sha("two"), "old", None), ("r", "other:y", sha("two"), "e", None)]
    replays = spark.createDataFrame(rows, "proof_id string, theorem_id string, body_sha256 string, environment string, source_artifact string")
    got = sorted(map(tuple, certify.replay_faults(records, replays, "e").collect()))
    assert got == [("p", "body_sha256"), ("p", "source_artifact"), ("p", "theorem_id"), ("q", "environment"), ("r", "proof_id")]
    assert ("q", "environment") not in map(tuple, certify.replay_faults(records, replays).collect())

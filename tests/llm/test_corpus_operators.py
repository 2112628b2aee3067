"""Quality rules, the Merkle manifest and importance resampling: brute force, held-out accuracy, odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, importance, merkle, quality

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, path string, score string, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOCS)


ODD = [
    (1, "a", "en", 3, "One two"), (2, None, None, None, None), (2, None, None, None, None), (3, "b", "", 0, ""), (None, "c", "en", 7, "No id HERE"),
    (5, "d", "ö", 1, "Grüße Ωmega é"), (6, "e", "zh", 2, "日本語 ABC"), (7, "f", "z", 1, "   \n\t "), (7, "f", "z", 1, "Again"), (8, "g", "long", 9, "Word and again " * 20_000),
]


# ---- Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, i):
    for nodes in levels[:-1]:
        yield nodes[i // 8 * 8 : i], nodes[i + 1 : i // 8 * 8 + 8]
        i //= 8


def manifest_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
    trees = [tree_of([leaf_of(r, r[4]) for r in by[x]]) for x in langs]
    top = tree_of([t[-1][0] for t in trees])
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = [*path_of(trees[k], i), *path_of(top, k)]
            leaf = cur = trees[k][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                cur = leaf_of(r, r[4] and re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            for a, b in path:
                cur = H("".join(a) + cur + "".join(b))
            yield r[0], leaf, trees[k][-1][0], top[-1][0], H("".join(x for a, b in path for x in a + b)), cur, cur == top[-1][0]


@pytest.mark.parametrize("many", [False, True])
def test_manifest_equals_brute_force(spark, tmp_path, many):
    rng = random.Random(3)
    rows = [*ODD, *((100 + i, "s", rng.choice(["en", "en", "en", "de", None, f"l{i % 11}"]), i, rng.choice(["Copy", f"Text {i}"])) for i in range(700 if many else 0))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # runs are cut by batches
    try:
        got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest_of(rows)))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(docs(spark, ODD[:1]))
    assert one.root == leaf_of(ODD[0], ODD[0][4]) and one.proofs.first()["path"] == []
    none = merkle.manifest(docs(spark, ODD[:1]).limit(0))
    assert none.root is None and none.proofs.count() == 0


def test_a_changed_row_is_found_by_its_proof(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(70)]
    m = merkle.manifest(docs(spark, rows), merkle.leaf(text=F.when(F.col("doc_id") == 33, F.lit("other")).otherwise(F.col("text"))))
    reached = m.proofs.select("doc_id", merkle.folded(merkle.hexed(F.col("altered")), F.col("path")).alias("to")).collect()
    assert {r["doc_id"] for r in reached if r["to"] != m.root} == {33}
    levels = [spark.read.parquet(f"{m.store}/level={k}").select(F.sum(F.octet_length("kids") / 32)).first()[0] for k in range(3)]
    assert levels == [70, 9, 2]


# ---- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def resampled(rows, target):
    found = [(d, features_of(t)) for d, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features_of(x))
    all_s, all_t = s.total(), t.total()
    out = []
    for d, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in f) // len(f) if f else 0
        h = int(H(f"7:{'' if d is None else d}")[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ranked = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {k: n + 1 for n, k in enumerate(ranked[: 25 * len(ranked) // 100])}
    return [(*r, drawn.get(r)) for r in out]


@pytest.mark.parametrize("size", [1 << 20, 64, 7])
def test_features_equal_brute_force(monkeypatch, size):
    """Words and pairs never cross texts, however the buffer is sliced; long words are hashed like short ones."""
    monkeypatch.setattr(importance, "SLICE", size)
    rng = random.Random(size)
    texts = ["", "one", "Two", "", "three four-five", "A" * 300 + " b" + "c" * 41, "日本語 ÄÖ a1b2\n\tx", *("".join(rng.choice("ab1 Z-é") for _ in range(rng.randint(0, 90))) for _ in range(60)), "end"]
    column = pa.array([t.encode() for t in ["skipped first", *texts]], pa.binary())[1:]
    got = [Counter() for _ in texts]
    for row, bucket in importance.features(column):
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            got[r][b] += 1
    assert got == [Counter(features_of(t)) for t in texts]
    assert list(importance.features(pa.array([], pa.binary()))) == []


def test_resampling_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta1"]
    rows = [(r[0], r[4]) for r in ODD] + [(100 + i // 2, " ".join(rng.choice(words) for _ in range(rng.choice([3, 19, 20, 21, 60])))) for i in range(200)]
    target = ["alpha beta gamma " * 30, None, "", "zeta1 delta"]
    frame = docs(spark, [(d, "s", "en", 1, t) for d, t in rows])
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    got = importance.resample(frame, bench).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, resampled(rows, target)))
    assert {r["rank"] for r in got} - {None} == set(range(1, 1 + sum(r["rank"] is not None for r in got)))
    empty = importance.resample(frame, bench.limit(0)).select(*names).collect()
    assert sorted(map(repr, map(tuple, empty))) == sorted(map(repr, resampled(rows, [])))
    assert importance.resample(frame.limit(0), bench).count() == 0


# ---- quality rules


def test_rules_compile_to_what_numpy_computes(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 9] < 0.7)).astype(float)
    model = quality.train(x, y)
    assert 0 < len(model.rules) < 40 and ((model.predict(x) >= 0.5) == (y > 0)).mean() > 0.97
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "doc_id long, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r["p"] for r in frame.select("doc_id", model.score().alias("p")).orderBy("doc_id").collect()]
    assert np.allclose(got, model.predict(x), atol=1e-12)


def test_lasso_is_optimal():
    """The gradient is within the penalty where the weight is zero, and equal to it elsewhere."""
    rng = np.random.default_rng(2)
    r = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * r[:, 0] - 2 * r[:, 1])))).astype(float)
    b, w = quality.lasso(r, y, 0.02, rounds=20_000)
    g = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / 300
    assert (np.abs(g) <= 0.02 + 1e-5).all() and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4) and 0 < (w != 0).sum() < 12


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op11_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"))
    rows = got.filter("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98


def test_held_out_labels_are_never_learnt_from(spark):
    frame = docs(spark, [(i, "s", "en", 1, "word " * (i % 7 + 1)) for i in range(90)])
    label = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(1 - 0)).otherwise((F.col("doc_id") % 7 > 3).cast("int"))
    seen, y = quality.sample(quality.statistics(frame), frame.select("doc_id", label.alias("quality")))
    other, z = quality.sample(quality.statistics(frame), frame.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(0)).otherwise((F.col("doc_id") % 7 > 3).cast("int")).alias("quality")))
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(90)) and (seen == other).all() and (y == z).all()


def test_quality_of_odd_tables(spark):
    frame = docs(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    for few in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = quality.quality(frame, few)[0].collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in quality.quality(frame, labels.limit(0))[0].collect())
    assert quality.quality(frame.limit(0), labels)[0].count() == 0
    assert quality.statistics_of(b"") == [0.0] * len(quality.STATISTICS)


# ---- places in an order


def test_places_need_no_window_over_all_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), rng.randint(0, 50)) for _ in range(500)]
    runs = common.in_order(spark.createDataFrame(rows, "g string, x int").repartition(7), ["g", "x"])
    base = common.bases(runs, "g")
    got = runs.join(base, ["part", "g"]).select("g", (F.col("base") + F.col("spot")).alias("at"), "x").collect()
    for g in "ab":
        xs = sorted(x for h, x in rows if h == g)
        assert [r["x"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])] == xs
        assert sorted(r["at"] for r in got if r["g"] == g) == list(range(len(xs)))

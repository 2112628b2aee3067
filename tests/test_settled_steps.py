"""Steps that read their input once, however many checks or fits follow."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import certify


def test_vector_faults_read_the_vectors_and_texts_once(spark, tmp_path):
    unit = np.eye(3)
    rows = [(k, unit[k % 3].tolist()) for k in range(9)]
    spark.createDataFrame(rows, "id long, v array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(k, "one" if k % 2 else "two" if k < 6 else None) for k in range(9)], "id long, tokens string").write.parquet(str(tmp_path / "t"))
    v, texts = spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "t"))
    got = certify.vector_faults(v, v.select("id", F.transform("v", lambda c: F.round(c, 9)).alias("v")), texts)
    assert not [f for f in got.inputFiles() if str(tmp_path) in f]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["a"], r["b"]) for r in got.filter("fault = 'tokens'").collect()} == {(1, 3), (1, 5), (1, 7), (0, 2), (0, 4)}
    assert {(r["a"], r["b"]) for r in got.filter("fault = 'collapse'").collect()} == {(k % 3, k) for k in range(3, 9)}


def test_a_fit_and_the_draws_read_the_citations_once(spark, monkeypatch):
    from tessera.plans import certify as plans

    read = []
    citations = plans.t.citations
    monkeypatch.setattr(plans.t, "citations", lambda *a: read.append(1) or citations(*a))
    assert plans.train_forward_lists(spark, "/root/testdata/sf0.001").columns == ["area", "work", "rank", "score"] and len(read) == 1
    files = plans.jump_triplets(spark, "/root/testdata/sf0.001").inputFiles()
    assert len(read) == 2 and not [f for f in files if "/root/testdata" in f]

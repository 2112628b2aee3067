"""Record readers, sinks, seals and comparisons."""

import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.certify import CheckError
from tessera.sources import records, sinks


def test_tex_sources_and_contexts(spark, tmp_path):
    body = "Before, \\citet{HJ}. 50\\% of it % but not \\cite{HJ}\n\\section{First steps}\nWe use \\parencite[see][p. 3]{HJ, other}.\n\\subsection*{How it ends}\nBy \\citep{ other , HJ} done, and \\cite{else}."
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tar:
        for name, text in (("A.LTX", body), ("a.bbl", "\\bibitem{HJ} Horn and\n Johnson. \\bibitem[x]{other} Other."), ("notes.txt", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "one.gz").write_bytes(gzip.compress(buf.getvalue()))
    (tmp_path / "two.gz").write_bytes(b"%PDF-1.4 \0")
    (tmp_path / "six.gz").write_bytes(gzip.compress(b"a single file"))
    rows = {r["path"][-6:]: r for r in records.tex_sources(spark, str(tmp_path)).collect()}
    assert rows["two.gz"]["body"] is None and rows["one.gz"]["body"].startswith("Before") and rows["six.gz"]["body"] == "a single file"
    got = records.citation_contexts(rows["one.gz"]["body"], {"HJ"})
    assert [h for h, _ in got] == ["(before the first section)", "First steps", "How it ends"]
    assert "50\\% of it \\section" in got[0][1] and "but not" not in got[0][1]
    assert len(records.citation_contexts(rows["one.gz"]["body"], {"other"})) == 2 and len(records.citation_contexts(rows["one.gz"]["body"], {"HJ"}, most=1)) == 1
    assert records.bib_entries(rows["one.gz"]["bib"]) == {"HJ": "Horn and Johnson.", "other": "Other."}


def test_declarations_follow_namespaces_and_skip_comments(spark):
    source = "namespace A\n/- theorem no : True\n/- nested -/ lemma no2 -/\ntheorem one : True := trivial\nsection\n@[simp] private lemma two (x) := x\nend\ntheorem _root_.B.three : True\n  theorem indented : True\nend A\n-- def four\ndef five := 1\ninstance : Inhabited A := six\nexample : True := trivial"
    want = [(4, "A.one"), (6, "A.two"), (8, "B.three"), (12, None), (13, None), (14, None)]
    assert records.declarations(source) == want
    rows = spark.createDataFrame([("f", source), ("g", None)], "file string, text string")
    assert [(r["line"], r["name"]) for r in records.parsed_declarations(rows, "file", "text").orderBy("line").collect()] == want


def test_concatenated_json(spark):
    x = spark.createDataFrame([('{"a": "𝔸"}\n {"a": "b"}',)], "value string")
    assert [r["a"] for r in records.concatenated_json(x, "value", "a string").collect()] == ["𝔸", "b"]
    with pytest.raises(ValueError):
        records.json_values("[1]")


def test_enriched_prefers_and_aligns(spark):
    works = spark.createDataFrame([("10.1/A", [(("u1",),), (("u2",),)]), ("10.2/b", [])], "doi string, authorships array<struct<author:struct<id:string>>>")
    want = spark.createDataFrame([("10.1/a",)], "doi string")
    assert records.enriched(works, want, records.AUTHORS).first()["authors"] == ["u1", "u2"]
    rows = spark.createDataFrame([("p", False, 1, "x"), ("p", True, 2, "y"), ("q", False, 3, "z")], "paper string, arxiv boolean, n int, v string")
    assert {r["paper"]: r["v"] for r in records.preferred(rows, "paper", "arxiv", "n").collect()} == {"p": "y", "q": "z"}
    a = spark.createDataFrame([(1, "a")], "id int, x string")
    assert records.aligned(a, a.withColumnRenamed("x", "y"), "id").count() == 1
    with pytest.raises(CheckError):
        records.aligned(a, a.withColumn("id", F.col("id") + 1), "id")
    with pytest.raises(CheckError):
        records.aligned(a.union(a), a, "id")


def test_xml_records(spark):
    x = spark.createDataFrame([("<r><id>1</id><cat>math.AG math.NT</cat></r>",)], "value string")
    assert records.xml_records(x, "value", "id string, cat string").first()["cat"] == "math.AG math.NT"


def test_halving_isolates_the_refused_item():
    def ask(batch):
        if "bad" in batch:
            raise ValueError
        return list(batch)

    assert records.halving(["a", "b", "bad", "c"], ask) == ["a", "b", "c"]


def test_page_source_plans_a_partition_for_each_url(spark):
    reader = records.PageSource({"urls": "http://a\nhttp://b"}).reader(None)
    assert [p.value for p in reader.partitions()] == ["http://a", "http://b"]


def test_sinks_seals_and_differences(spark, tmp_path):
    x = spark.createDataFrame([(1, 0.5, None), (2, 1.5, "b")], "k int, v double, t string")
    sinks.write_once(x, str(tmp_path / "x"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(x, str(tmp_path / "x"))
    sinks.write_jsonl(x, str(tmp_path / "j"))
    back = spark.read.parquet(str(tmp_path / "x"))
    assert sinks.broken(sinks.seals({"x": x}), sinks.seals({"x": back.orderBy(F.desc("k"))})).count() == 0
    assert [r["name"] for r in sinks.broken(sinks.seals({"x": x}), sinks.seals({"x": x.filter("k = 1")})).collect()] == ["x"]
    assert sinks.differences(x, back.withColumn("v", F.col("v") + 1e-12), ["k"]).count() == 0
    assert [(r["k"], r["column"]) for r in sinks.differences(x, back.withColumn("v", F.col("v") + F.col("k") - 1), ["k"]).collect()] == [(2, "v")]
    done = sinks.resume(spark, x, str(tmp_path / "r"), "k", lambda d: d.filter("k = 1"))
    assert done.count() == 1
    assert sinks.resume(spark, x, str(tmp_path / "r"), "k", lambda d: d).count() == 2

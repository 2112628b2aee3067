"""The driver contract holds, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.oracle_sql()) >= 90


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["grid_cells", "flow", "doc_frequency", "stratified_auc", "registry_classes"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as contract

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = contract.queries()[name](spark, d)
    cols = ", ".join(sorted(df.columns))
    want = con.sql(f"select {cols} from ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want))


def test_library_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tessera.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'grid_cells' in q and 'pipeline' not in q, q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p

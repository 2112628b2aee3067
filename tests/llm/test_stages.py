"""Every pipeline stage on odd tables, and the dedup operators on texts longer than their slices."""

import hashlib
import random

import pytest

import corpus_pipeline
from tessera.llm import hashing, ngram_join, substring_dedup, suffix_dedup, superkmers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "\n".join(f"line number {k} of the text that is copied whole" for k in range(8))
ROWS = [
    (1, LINES, "en"), (1, LINES, "en"), (2, LINES, "en"), (None, None, None), (None, "", "fr"), (3, "", None), (4, None, "de"), (5, " \n\t", "en"),
    (6, "12 34 %%", "en"), (7, "a short text of seven words here", "en"), (7, "another text under the same number, which is longer", None), (8, "mail a.b@example.org now " * 30, "en"),
]


def table(spark, rows):
    return spark.createDataFrame([(d, t, la, "src", len(t or "")) for d, t, la in rows], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = table(spark, ROWS)
    out = stage(spark, docs, "").collect()
    texts = lambda rows: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in rows)
    assert stage(spark, docs.limit(0), "").count() == 0
    if name == "best_fit_packing":
        pieces = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out)
        assert pieces == sorted((d is not None, d or 0) for d, _, _ in ROWS) and all(r["length"] >= 1 and r["piece"] == 0 for r in out)
        return
    assert out[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    kept = {r["doc_id"] for r in out}
    if name == "language_id":
        # without letters there is no language; the rest stays
        assert kept == {1, 2, 7, 8} and sum(r["doc_id"] == 1 for r in out) == 2
    elif name == "line_dedup":
        assert 2 not in kept and sum(r["doc_id"] == 1 for r in out) == 2 and len(out) == len(ROWS) - 1
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)
    elif name == "ngram_jaccard_join":
        assert 2 not in kept and sum(r["doc_id"] == 1 for r in out) == 2 and len(out) == len(ROWS) - 1
    else:
        assert len(out) == len(ROWS) and not any("a.b@example.org" in (r["text"] or "") for r in out)
        same = [x for x in texts(out) if x[1] != 8]
        assert same == [x for x in texts(docs.collect()) if x[1] != 8]


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def test_texts_longer_than_slices_and_scans(spark):
    """A passage copied across the slice's end and into another long text, found by all three; nothing else goes."""
    size = max(hashing.SLICE, superkmers.SCAN)
    a, b, passage = words(1, size // 3), words(2, size // 3), words(3, 60)
    a[size // 7 : size // 7] = passage
    a += passage  # repeated near the end of the same text
    b[size // 5 : size // 5] = passage
    texts = [" ".join(a), " ".join(b), " ".join(b[:-3] + ["x", "y", "z"])]
    assert all(len(t) > 2 * hashing.SLICE and len(t) > superkmers.SCAN for t in texts)
    docs = table(spark, [(k, t, "en") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in substring_dedup.repeated_words(docs).collect()}
    n, shared = [len(t.split()) for t in texts], len(b) - 3
    assert [got[k]["n_words"] for k in range(3)] == n
    assert [got[k]["n_removed"] for k in range(3)] == [120, shared, shared]
    left = " ".join(a[: size // 7] + a[size // 7 + 60 : -60])
    assert got[0]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_bytes(docs).collect()}
    data, common = " ".join(passage).encode(), len(" ".join(b[:-3]).encode()) + 1
    assert got[0]["n_spans"] == 1 and len(data) <= got[0]["n_removed"] <= len(data) + 2 and got[1]["n_spans"] == 1
    assert common <= got[2]["n_removed"] <= common + 3 and got[2]["n_bytes"] == len(texts[2])
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs).collect()}
    assert [got[k]["component_id"] for k in range(3)] == [0, 1, 1]
    want = len({tuple(a[i : i + 5]) for i in range(len(a) - 4)})
    assert got[0]["n_shingles"] == want

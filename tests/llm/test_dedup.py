"""The dedup operators against brute force, on plain, hard and planted inputs."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bwt, line_dedup, ngram_join, substring_dedup, suffix_dedup

SCHEMA = "text string, doc_id long, lang string, mh long, rid string, n int"


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(t, i, "en", 1, "x", None) for t, i in zip(texts, ids, strict=True)], SCHEMA)


def prose(seed, n_docs=40, n_words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, n_words))) for _ in range(n_docs)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs += [d + " " + passage + " " + rng.choice(docs) for d in docs[:12]]
    for d in docs[5:15]:
        w = d.split()
        w[rng.randrange(len(w))] = "Edited"
        docs.append(" ".join(w))
    docs += [docs[0]] * 5 + [None, "", "   \n\t ", "ab", "a" * 700, "xy " * 300, "z" * 100, passage.upper()]
    return docs


def removed_bytes(texts, width=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                mask[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((len(b), sum(mask), sum(bool(r) for r in bytes(mask).split(b"\0")), hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(texts, width=35):
    words = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        mask = [False] * len(w)
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                mask[i : i + width] = [True] * width
        out.append((len(w), sum(mask), hashlib.sha256(b" ".join(x for x, m in zip(w, mask, strict=True) if not m)).hexdigest()))
    return out


def components(texts):
    sets = []
    for t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_exact(spark, seed):
    texts = prose(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed_bytes(texts)


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup_is_exact(spark, seed):
    texts = prose(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeated_words(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed_words(texts)


@pytest.mark.parametrize("seed", [5, 6])
def test_ngram_join_is_exact(spark, seed):
    texts = prose(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_ngram_join_with_frequent_tokens(spark, monkeypatch):
    """Nearly every token of the frequent class: the combinations carry the search."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "LOCAL", 1)
    rng = random.Random(9)
    base = [rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(90)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


@pytest.mark.parametrize("seed", [10, 11])
def test_long_lists_are_tested_in_blocks(spark, monkeypatch, seed):
    """A group whose members are near the threshold, so that many stay apart after the first round."""
    monkeypatch.setattr(ngram_join, "SHORT", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(seed)
    base = [f"word{k}" for k in range(70)]
    texts = []
    for _ in range(45):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_hot_minimisers_are_split(spark, monkeypatch):
    from tessera.llm import superkmers

    monkeypatch.setattr(superkmers, "HOT", 3)
    texts = prose(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed_bytes(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeated_words(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed_words(texts)


def test_contents_of_a_minimiser_are_told_apart(spark):
    """Texts of one window and one minimiser whose contents agree in 32 bits of their fingerprints, but not in all 64."""
    texts = [f"the opening words that every one of these documents begins w{k:040d}" for k in (37677, 59915)]
    assert [r["n_removed"] for r in suffix_dedup.repeated_bytes(frame(spark, texts)).collect()] == [0, 0]
    start = "these are the opening words that every one of the documents has and they go on for a while until the part that differs at"
    texts = [" ".join([*start.split(), *(2 * c for c in f"{k:010d}")]) for k in (63967, 170385)]
    assert [r["n_removed"] for r in substring_dedup.repeated_words(frame(spark, texts)).collect()] == [0, 0]


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    for run in (suffix_dedup.repeated_bytes, substring_dedup.repeated_words, ngram_join.near_duplicates, line_dedup.deduplicate_lines):
        assert run(none).count() == 0
    some = frame(spark, ["a b c d e f " * 30, "a b c d e f " * 30, None], [None, 4, None])
    assert suffix_dedup.repeated_bytes(some).count() == 3
    assert substring_dedup.repeated_words(some).count() == 3
    assert ngram_join.near_duplicates(some).count() == 3
    assert line_dedup.deduplicate_lines(some).count() == 3


def test_suffix_dedup_of_a_null_id_comes_first(spark):
    text = "once upon a time " * 20 + "the end"
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(frame(spark, [text, text], [7, None])).collect()}
    assert got[7] == len(text) and got[None] < len(text)


def test_patience_takes_what_rises_on_both_sides():
    assert line_dedup.rising([5, 1, 2, 9, 3]) == [1, 2, 4]
    assert line_dedup.patience([1, 2, 3]) == [0, 1, 2] and line_dedup.patience([]) == []
    assert line_dedup.patience([7, 1, 2, 3]) == [1, 2, 3]
    # 4 is repeated: it's taken where it fits between the ones that are met once
    assert line_dedup.patience([4, 1, 3, 4, 8, 4]) == [1, 2, 3, 4]


def lines_left(texts, least=line_dedup.BLOCK):
    """Every document against all earlier ones: runs of lines of enough characters that one of them holds go."""
    split = [[x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
    split = [[x.strip(" \t\n\v\f\r") for x in b] for b in split]
    out = []
    for j, (t, b) in enumerate(zip(texts, split, strict=True)):
        gone = [any(a == b for a in split[:j]) and any(b)] * len(b)
        for a in split[:j]:
            have = {tuple(a[s:e]) for s in range(len(a)) for e in range(s + 1, len(a) + 1)}
            for s in range(len(b)):
                for e in range(s + 1, len(b) + 1):
                    if sum(map(len, b[s:e])) >= least and tuple(b[s:e]) in have:
                        gone[s:e] = [True] * (e - s)
        kept, k = [], -1
        for x in (t or "").split("\n"):
            k += bool(x.strip(" \t\n\v\f\r"))
            if not (b and gone[max(k, 0)]):
                kept.append(x)
        out.append("\n".join(kept) if t else t)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = ["x" * 31 + c for c in "abcd"] + ["é" * 12 + c for c in "abcdef"] + list("pqrs") + ["", "  ", "\t"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    texts += [None, "", texts[3], " " + texts[4].replace("\n", " \n"), "p", "p", "\n\n"]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(frame(spark, texts), moved=True).collect()}
    assert [rows[i]["text"] for i in range(len(texts))] == lines_left(texts)
    assert all(r["n_lines"] == (r["text"] or "").count("\n") + bool(r["text"]) for r in rows.values() if not r["n_removed"])


def test_line_dedup_meets_holders_that_are_not_first(spark):
    x, short = "the line that three documents hold in all", ["one", "two", "three"]
    texts = [["a", x, "b"], ["c", x, *short, "d"], ["e", x, *short, "f"]]
    rows = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(frame(spark, ["\n".join(t) for t in texts])).collect()}
    assert rows == {0: "\n".join(texts[0]), 1: "c\none\ntwo\nthree\nd", 2: "e\nf"}


def test_line_dedup_of_long_lines_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.hashing.SLICE", 64)
    long = "long " * 40
    texts = [f"own\n{long}\nend of the first", f"other\n  {long}\nend of the second\n", f"third\nshort ones\n{long}x\nend"]
    rows = line_dedup.deduplicate_lines(frame(spark, [*texts, texts[1]], [0, 1, 2, 1])).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"]) for r in rows) == [(0, texts[0], 3), (1, "other\nend of the second\n", 4), (1, "other\nend of the second\n", 4), (2, texts[2], 4)]


def test_line_dedup_tells_moved_passages(spark):
    x, y, z = (f"line {k} of the text that is moved around" for k in range(3))
    texts = ["\n".join(t) for t in ([x, y, z, "end"], ["a", z, x, y, "b"], ["c", x, "d", x, "e"])]
    cut = lambda **k: {r["doc_id"]: (r["text"], r["n_removed"], r["n_moved"]) for r in line_dedup.deduplicate_lines(frame(spark, texts), **k).collect()}
    assert cut(moved=True)[1] == ("a\nb", 3, 1) and cut(moved=True)[2] == ("c\nd\ne", 2, 1)
    assert cut()[1] == (f"a\n{z}\nb", 2, 1) and cut()[2] == (f"c\n{x}\nd\ne", 1, 1)


def diffed(texts, least=line_dedup.BLOCK):
    """Every document against each earlier one that held some of its keys first: a patience diff of those keys' places, by its textbook description."""
    split = [[x.strip(line_dedup.BLANK) for x in (t or "").split("\n") if x.strip(line_dedup.BLANK)] for t in texts]

    def keys(b):
        out = set()
        for s in range(len(b)):
            out |= {next(((s, e) for e in range(s + 1, len(b) + 1) if sum(map(len, b[s:e])) >= least), None)}
            out |= {next(((a, s + 1) for a in range(s, -1, -1) if sum(map(len, b[a : s + 1])) >= least), None)}
        return sorted(out - {None})

    def longest(pairs):  # of (later, earlier) places, the longest that rises in both; of several the one that patience sorting gives
        return [pairs[k] for k in line_dedup.rising([x for _, x in pairs])]

    first, out = {}, []
    for j, b in enumerate(split):
        whole = next((i for i in range(j) if split[i] == b), None) if b else None
        by = {} if whole is None else {whole: [((0, len(b)), (len(b), len(b)))]}
        for span in keys(b):
            holder = first.get(tuple(b[slice(*span)]))
            if holder:
                by.setdefault(holder[0], []).append((span, holder[1]))
        gone = [False] * len(b)
        for pairs in by.values():
            # a copy's whole text is packed as (0, n) and stands at n of the holder
            pairs = sorted((s[0] << 32 | s[1], at if isinstance(at, int) else at[0]) for s, at in pairs)
            once = longest([(y, x) for y, x in pairs if sum(x == v for _, v in pairs) == 1])
            fences, took = [(-1, -1), *once, (1 << 63, 1 << 70)], list(once)
            for (y0, x0), (y1, x1) in itertools.pairwise(fences):
                took += longest([(y, x) for y, x in pairs if y0 < y < y1 and x0 < x < x1])
            for y, _ in took:
                for k in range(y >> 32, y & 0xFFFF_FFFF):
                    gone[k] = True
        for s, e in keys(b):
            first.setdefault(tuple(b[s:e]), (j, s << 32 | e))
        out.append([x for x, g in zip(b, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_equals_patience_diffs_of_all_pairs(spark, seed):
    rng = random.Random(50 + seed)
    pool = ["x" * 31 + c for c in "abcdefgh"] + ["é" * 12 + c for c in "abcdef"] + list("pqrs") + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(40)] + [None, ""]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(frame(spark, texts)).collect()}
    left = [[x.strip(line_dedup.BLANK) for x in (rows[i]["text"] or "").split("\n") if x.strip(line_dedup.BLANK)] for i in range(len(texts))]
    assert left == diffed(texts)
    assert any(r["n_moved"] for r in rows.values()) and any(r["n_removed"] for r in rows.values())


def test_the_alignment_decides_what_goes(spark, monkeypatch):
    """Were everything called moved, as a diff that aligns nothing would, nothing would be deleted."""
    texts = ["\n".join([end, *(f"line {k} of the text that is held twice" for k in range(5))]) for end in ("one", "two")]
    assert sum(r["n_removed"] for r in line_dedup.deduplicate_lines(frame(spark, texts)).collect()) == 5
    found = line_dedup.aligned(frame(spark, texts)).collect()
    assert [(len(r["spans"]) > 0, r["moved"]) for r in found] == [(True, [])]
    monkeypatch.setattr(line_dedup, "_aligned", lambda a, am, x, y: [[[]] * len(a), y.to_pylist()])
    assert sum(r["n_removed"] for r in line_dedup.deduplicate_lines(frame(spark, texts)).collect()) == 0


def test_line_dedup_deletes_from_the_later_document(spark):
    shared = ["a long line that both documents hold", "and a second one right after it", ""]
    one = ["first document has its own opening", *shared, "and its own end"]
    two = ["second document starts another way", "with two lines", *shared, "short", "a different end of the text"]
    texts = ["\n".join(one), "\n".join(two), "\n".join(one), "no shared line in here at all", None, ""]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(frame(spark, texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[0]["n_removed"] == 0
    assert rows[1]["text"].split("\n") == ["second document starts another way", "with two lines", "short", "a different end of the text"]
    assert rows[2]["text"] == "" and rows[2]["n_removed"] == len(one)
    assert rows[3]["text"] == texts[3] and rows[4]["text"] is None and rows[5]["text"] == ""
    assert rows[0]["mh"] == 1 and rows[0]["lang"] == "en"


def test_line_dedup_finds_members_of_a_large_group(spark):
    line = [f"line number {k} of the text that all copy" for k in range(6)]
    texts = ["\n".join([*line, f"own line of document {k}, unlike the others"]) for k in range(100)]
    rows = line_dedup.deduplicate_lines(frame(spark, texts)).collect()
    assert sorted(r["n_removed"] for r in rows) == [0] + [6] * 99


def test_line_dedup_finds_common_passages_beside_rare_lines(spark):
    """A line of over 64 documents, in a document that shares a rare line with another one."""
    common = "a license line that a great many of the documents carry"
    texts = [f"{common}\nown opening of document {k}, unlike the others" for k in range(100)]
    texts += ["a rare line that only two of the documents hold\nand the end", f"a beginning of its own, found nowhere else\na rare line that only two of the documents hold\nthen more of its own, found nowhere else\n{common}"]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(frame(spark, texts)).collect()}
    assert [rows[k]["n_removed"] for k in range(102)] == [0] + [1] * 99 + [0, 2]


def test_line_dedup_finds_repeated_moved_and_short_lines(spark):
    passage = [f"line {k} of the passage that is repeated" for k in range(3)]
    verse = ["roses are red", "violets", "are blue", "", "sugar is sweet"]
    texts = [
        ["first opening", *passage, "first end"],
        ["second opening", *passage, "second middle", *passage, "second end"],
        ["third opening", *verse, "third end"],
        ["fourth opening", *verse, "fourth middle", *passage, "fourth end", *verse],
        ["fifth opening", *passage[::-1], "fifth end", *verse[:2]],
    ]
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(frame(spark, ["\n".join(t) for t in texts]), moved=True).collect()}
    assert [rows[k]["text"].split("\n") for k in range(5)] == [texts[0], ["second opening", "second middle", "second end"], texts[2], ["fourth opening", "fourth middle", "fourth end"], ["fifth opening", "fifth end", *verse[:2]]]


@pytest.mark.parametrize("settled", [1, 3, 1 << 30])
def test_merged_transforms_find_every_repeat(monkeypatch, settled):
    monkeypatch.setattr(bwt, "SETTLED", settled)
    rng = random.Random(settled)
    for _ in range(150):
        letters, width = rng.choice([2, 4, 26]), rng.randint(1, 9)
        strings = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        strings += strings[: rng.randint(0, 2)]
        weights = np.array([rng.randint(1, 2) for _ in strings])
        which, off, group = bwt.repeats(strings, width, weights, shard_bytes=rng.choice([1, 30, 1000]))
        count = Counter()
        for s, w in zip(strings, weights, strict=True):
            for i in range(len(s) - width + 1):
                count[s[i : i + width]] += int(w)
        want = {(i, j) for i, s in enumerate(strings) for j in range(len(s) - width + 1) if count[s[j : j + width]] > 1}
        got = list(zip(which.tolist(), off.tolist(), strict=True))
        assert len(got) == len(want) and set(got) == want
        named = {(g, strings[i][j : j + width]) for (i, j), g in zip(got, group.tolist(), strict=True)}
        assert len(named) == len({g for g, _ in named}) == len({w for _, w in named})


def test_suffix_dedup_rests_on_the_transforms(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_by_bucket", lambda width, gram: lambda pdf: suffix_dedup.pd.DataFrame([], columns=["mh", "ch", "s", "e", "first"]))
    assert sum(r["n_removed"] for r in suffix_dedup.repeated_bytes(frame(spark, prose(3))).collect()) == 0

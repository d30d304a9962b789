"""Jaccard join and passages against brute force on texts made by hypothesis-like random draws."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from casefile.llm import hashing, jaccard, substrings
from casefile.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n string, label string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus(seed=5, n=60):
    """Texts with exact and near copies, shared passages, odd white space, nulls, repeats and empty ones."""
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("Ka", "lo", "mi", "né", "st") for b in ("ra", "n", "tu", "ö")]
    say = lambda m: " ".join(r.choice(vocab) for _ in range(m))
    passage = say(95)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind < 2 or not rows:
            text = say(r.randint(1, 120))
        elif kind == 2:
            text = rows[r.randrange(len(rows))][1]
        elif kind == 3:
            w = (rows[r.randrange(len(rows))][1] or "x").split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
        elif kind == 4:
            text = f"{say(r.randint(0, 9))} {passage}\n{say(r.randint(0, 40))}"
        else:
            text = r.choice(["", None, " \t\n ", "a", "one\x0btwo\x0cthree", say(3), passage + " " + passage])
        rows.append((i * 3, text, "en", "s", "x", "y"))
    rows.append(rows[0])
    return rows


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 5), (5, 80, 6), (2, 50, 7)])
def test_jaccard_equals_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    got = jaccard.join_components(spark.createDataFrame(rows, DOCS), k=k, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute_components(rows, k, percent)


def test_jaccard_dense_group_and_small_tiles(spark, monkeypatch):
    """Near copies that link in chains, with tiles cut to two sets: all links are found."""
    monkeypatch.setattr(jaccard, "TILE", 2)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(30):
        w = base.copy()
        w[i] = f"z{i}"
        w[(i + 1) % 40] = f"y{i // 2}"
        rows.append((i, " ".join(w), "en", "s", "x", "y"))
    got = jaccard.join_components(spark.createDataFrame(rows, DOCS), k=1, percent=90)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 1, 90)


def test_jaccard_null_ids_and_empty(spark):
    rows = [(None, "a b c d e", "", "", "", ""), (None, "a b c d e", "", "", "", ""), (4, "a b c d e", "", "", "", ""), (2, None, "", "", "", "")]
    got = jaccard.join_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 1, None), (None, 1, None), (4, 1, 4), (2, 0, 2)], key=repr)
    assert jaccard.join_components(spark.createDataFrame([], DOCS)).collect() == []


def test_jaccard_large_sets(spark):
    r = random.Random(3)
    a = [str(r.randrange(10**9)) for _ in range(6000)]
    b = a[:]
    b[3000:3100] = [str(r.randrange(10**9)) for _ in range(100)]
    c = a[:4000] + [str(r.randrange(10**9)) for _ in range(2000)]
    rows = [(i, " ".join(x), "", "", "", "") for i, x in enumerate((a, b, c))]
    got = jaccard.join_components(spark.createDataFrame(rows, DOCS), k=5, percent=80)
    assert sorted(map(tuple, got.collect())) == [(0, 5996, 0), (1, 5996, 0), (2, 5996, 2)]


def brute_repeats(rows, k=20):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in sorted({(i, t or "") for i, t, *_ in rows})}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), (i, j))
    out = []
    for i, t, *_ in rows:
        w = words[i]
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (i, j):
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("k", "seed"), [(20, 5), (20, 8), (6, 9), (2, 1), (36, 4), (60, 3)])
def test_passages_equal_brute_force(spark, k, seed):
    rows = corpus(seed)
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), k=k, keep=("n", "label"))
    assert got.columns == ["doc_id", "n", "label", "n_words", "n_removed", "kept_sha256", "text", "spans"]
    out = got.collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute_repeats(rows, k)
    for r in out:
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert r.n_removed == 0 or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_passages_wide_ids_long_texts_and_paths(spark, monkeypatch):
    """Ids of any size, a text over many source blocks, copies of it with gaps, and rows that repeat."""
    monkeypatch.setattr(substrings, "SOURCE_BLOCK", 64)
    r = random.Random(6)
    long = [f"w{r.randrange(300)}" for _ in range(3000)]
    cut = long[:500] + ["odd"] + long[501:1700] + ["x", "y"] + long[1650:]
    rows = [(2**62, " ".join(long)), (-(2**63), " ".join(long[700:900])), (2**63 - 1, " ".join(cut)), (2**40, " ".join(cut[100:])), (2**40, " ".join(cut[100:])), (5, " ".join(long[2000:2500] * 2))]
    rows = [(i, t, "", "", "", "") for i, t in rows]
    for k in (5, 20):
        got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), k=k).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, k)


def test_repeated_paths_compact_to_one_unitig(spark, monkeypatch):
    """Two copies of a text share one path over all blocks of the source; a branch cuts it."""
    monkeypatch.setattr(substrings, "SOURCE_BLOCK", 16)
    schema = "mm long, c long, first struct<id:long,word:int>, len int, head long, tail long"
    chain = [(i, i, (7, 5 * i), 5, i, i + 1) for i in range(40)]
    far = [(100, 100, (9, 3), 5, 900, 901)]
    nothing = spark.createDataFrame([], "head long, tail long")
    roots = {r.c: (r.first.id, r.root) for r in substrings.unitigs(spark.createDataFrame(chain + far, schema), nothing).collect()}
    assert roots == {**{i: (7, 0) for i in range(40)}, 100: (9, 3)}
    branch = spark.createDataFrame([(20, 555)], "head long, tail long")
    roots = {r.c: r.root for r in substrings.unitigs(spark.createDataFrame(chain, schema), branch).collect()}
    assert roots == {i: 0 if i < 20 else 100 for i in range(40)}


def test_passages_null_ids_negative_ids_and_empty(spark):
    text = " ".join(map(str, range(25)))
    got = substrings.remove_repeats(spark.createDataFrame([(None, text, "", "", "", ""), (-5, text, "", "", "", ""), (-9, text, "", "", "", "")], DOCS))
    assert sorted((r.doc_id, r.n_removed) for r in got.collect() if r.doc_id) == [(-9, 0), (-5, 25)]
    assert [r.n_removed for r in got.collect() if r.doc_id is None] == [0]
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_fragments_across_blocks(monkeypatch):
    """Cutting into blocks changes fragments, not the windows they cover."""
    words = np.random.default_rng(1).integers(0, 30, 500).astype(np.uint64)
    at = np.array([0, 120, 130, 500])

    def covered():
        return sorted((int(r), int(s) + i) for row, start, length, *_ in substrings.fragments(words, at, 20) for r, s, n in zip(row, start, length, strict=True) for i in range(n))

    whole = covered()
    monkeypatch.setattr(substrings, "BLOCK", 37)
    assert covered() == whole == [(0, i) for i in range(101)] + [(2, i) for i in range(351)]


def test_word_hashes_of_windows(monkeypatch):
    texts = ["Ab c\tde", "", None, "x" * 300 + " y", " ", "é ß\x0bq", "tail"]
    monkeypatch.setattr(hashing, "WINDOW", 5)
    data, offsets = hashing.text_bytes(pa.array(texts, pa.string()))
    words, at = hashing.word_hashes(data, offsets, hashing.LOWER)
    assert np.diff(at).tolist() == [len(WORD.findall(t or "")) for t in texts]
    alone, _ = hashing.word_hashes(*hashing.text_bytes(pa.array(["ab c de"])))
    assert words[:3].tolist() == alone.tolist()


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in components(chain).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

"""Near-duplicates of the pipeline against brute force over all pairs."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline as P
from lathework.llm import near_sets


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) > n else {tuple(words)}


def changed(words, at, rng):
    return [f"new{rng.random()}" if k in at else w for k, w in enumerate(words)]


def texts():
    """Short and long texts with a cut end or changed words, on both sides of 0.8, a common passage, and a large group of near copies."""
    rng = random.Random(7)
    out = []
    for q in range(120):
        n = [8, 9, 10, 12, 16, 30, 129, 400][q % 8]
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + 1)]
        out += [words[:-1], words]
        if n > 100:
            out += [changed(words, {rng.randrange(n) for _ in range(k)}, rng) for k in (1, 2, 3, 6, 12)]
    passage = [f"p{k}" for k in range(60)]
    out += [[f"q{k}x{j}" for j in range(40)] + passage for k in range(60)]
    base = [f"b{k}" for k in range(150)]
    out += [changed(base, {rng.randrange(150) for _ in range(3)}, rng) for _ in range(60)]
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("dense", [near_sets.DENSE, 4])
def test_all_links(spark, monkeypatch, dense):
    """The components are those of all pairs with 0.8 or more, pairs of 4 and 5 shingles among them."""
    monkeypatch.setattr(near_sets, "DENSE", dense)
    own = dict(enumerate(texts()))
    sets = {i: shingles(t) for i, t in own.items()}
    parent = {i: i for i in own}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = [(a, b) for a, b in itertools.combinations(own, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum(5 * len(sets[a] & sets[b]) == 4 * len(sets[a] | sets[b]) for a, b in near) >= 15
    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in own.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r["component_id"] for r in near_sets.near_duplicates(docs).collect()}
    assert found == {i: find(i) for i in own}
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect()} == {i for i in own if find(i) == i}


def test_short_texts(spark):
    """Texts of 8 and 9, 9 and 10, 10 and 11 words, whose sets have an even and an odd size, are linked."""
    rng = random.Random(3)
    rows = []
    for q in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(9 + q % 3)]
        rows += [(2 * q, " ".join(words)), (2 * q + 1, " ".join(words[:-1]))]
    found = near_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found) and len(found) == 600


def test_majority_of_words():
    rng = np.random.default_rng(1)
    held = rng.integers(1, 40, 200)
    starts = np.concatenate([[0], np.cumsum(held)[:-1]])
    words = rng.integers(0, 2**64, held.sum(), dtype=np.uint64) | rng.integers(0, 2**64, held.sum(), dtype=np.uint64)
    got = near_sets.majority(words, starts, held)
    for a, n, g in zip(starts, held, got, strict=True):
        want = sum(1 << b for b in range(64) if 2 * sum(int(w) >> b & 1 for w in words[a : a + n]) > n)
        assert want == int(g)


def test_alike_sets_share_a_block():
    """Of pairs at the limit, with the smaller set anywhere in its range, none in 2,000 is lost."""
    rng = np.random.default_rng(2)
    for _ in range(2_000):
        n = int(np.exp(rng.uniform(np.log(4), np.log(3_000))))
        m = rng.integers(n, int(n / 0.8) + 1)
        d = int((n + m) / 9 + 1e-9)
        only = (d - (m - n)) // 2  # shingles of the smaller set alone
        pool = rng.integers(-(2**63), 2**63, m + only)
        small, large = np.sort(np.concatenate([pool[: n - only], pool[m:]])), np.sort(pool[:m])
        assert len(small) == n and 5 * (n - only) >= 4 * (m + only) - 1e-9
        a, b = near_sets.blocks([small, large])
        assert np.intersect1d(a, b).size


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _row string, _key string, text_key long, rep string")


def test_keep_one(spark):
    """Clashing columns stay as they are; texts that share an id but not a group both stay; repeats go."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "some quite different words in here now"
    rows = [(1, a, "x", "k", 5, "r"), (1, b, "x", "k", 5, "r"), (2, c, None, None, None, None), (2, c, None, None, None, None), (3, a, "y", "k", 5, "r"), (None, b, "z", "k", 5, "r"), (None, "only without an id at all here", "z", "k", 5, "r"), (4, None, "n", "", 1, ""), (5, "", "n", "", 1, "")]
    docs = rows_of(spark, rows)
    out = near_sets.keep_one(docs, near_sets.near_duplicates(docs))
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, a), (1, b), (2, c), (None, "only without an id at all here"), (4, None)], key=repr)
    empty = rows_of(spark, [])
    assert near_sets.keep_one(empty, near_sets.near_duplicates(empty)).count() == 0

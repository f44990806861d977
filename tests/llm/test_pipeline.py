"""The pipeline's stages against brute-force versions, one after the other."""

import collections
import hashlib
import itertools
import os
import sys

from pyspark.sql import functions as F

import corpus_pipeline as P
from lathework.llm import bpe, mixing
from lathework.session import materialize

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import plain_lines  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = materialize(P.language(spark, docs, sf))
    assert kept.columns == names
    ids = {r["doc_id"] for r in kept.collect()}
    assert all(i in ids for i, t in texts.items() if t and len(t) > 200)

    cleaned = materialize(P.lines(spark, kept, sf))
    assert cleaned.columns == names
    clean = {r["doc_id"]: r for r in cleaned.collect()}
    assert clean.keys() == ids and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert {i: r["text"] for i, r in clean.items()} == dict(plain_lines(kept.collect()))

    single = materialize(P.near_duplicates(spark, cleaned, sf))
    assert single.columns == names
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    groups = plain_groups({i: r["text"] for i, r in clean.items()})
    assert left == {i: r["text"] for i, r in clean.items() if groups[i] == i} and single.count() == len(left)

    mixed = materialize(P.mixture(spark, single, sf))
    assert mixed.columns == names
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert {i: n for i, n in want.items() if n} == dict(copies) and max(copies.values()) <= 2

    codec = bpe.Codec(*bpe.default_vocabulary())
    out = P.tokens(spark, mixed, sf).collect()
    assert len(out) == sum(copies.values())
    for r in out[:50]:
        assert r["ids"] == codec.encode(left[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest()


def plain_groups(texts):
    """All pairs: the smallest id that each text reaches over links of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)} - {()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_clashing_columns_and_repeated_ids(spark, sf):
    """Columns named like helpers come out as they went in; rows of one id with different texts are different documents."""
    clash = ["salt", "has", "target", "base", "rate", "_key", "_drop", "_row", "_rest", "_lang", "_sure", "_copies", "n_lines", "n_removed", "text_key", "lambda", "group"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 300").limit(60)
    docs = docs.withColumn("doc_id", F.col("doc_id") - F.col("doc_id") % 2).withColumns({c: F.concat(F.lit(c), F.col("text")) for c in clash})
    before = {(r["doc_id"], r["salt"]) for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        was = docs.count()
        docs = materialize(stage(spark, docs, sf))
        rows = docs.collect()
        assert docs.columns[5:] == clash, name
        assert all(r[c] == c + r["salt"][4:] for r in rows for c in clash) and {(r["doc_id"], r["salt"]) for r in rows} <= before
        assert len(rows) >= 0.7 * was
    assert len({r["doc_id"] for r in rows}) < len({r["salt"] for r in rows})
    assert P.tokens(spark, docs, sf).count() == len(rows)


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words are here and there", "en", "a", 29), (3, "some words are here and there", "en", "a", 29), (None, "ein Text ohne Nummer und so weiter", None, None, 34), (4, "noch ein Text mit Worten darin", "de", "b", 30), (5, "12 34", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf))
    left = {r["doc_id"] for r in docs.collect()}
    assert left <= {3, 4, None} and 3 in left
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf))
    assert docs.count() == 0

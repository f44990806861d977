"""The factorization machine: gradients, interactions, held-out texts, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from lathework.llm import registry, toxicity


def plain_logit(machine, row):
    """The definition, pair by pair."""
    at = {int(f): k for k, f in enumerate(machine.ids)}
    own = [at[f] for f in row if f in at]
    pairs = sum(float(machine.v[a] @ machine.v[b]) for i, a in enumerate(own) for b in own[:i])
    return machine.bias + sum(machine.w[k] for k in own) + pairs


def chance_machine(seed=0, n=30):
    r = np.random.default_rng(seed)
    return toxicity.Machine(np.sort(r.choice(1 << toxicity.BITS, n, False)), r.normal(size=n), r.normal(size=(n, 4)), 0.3)


def test_logits_like_plain():
    m = chance_machine()
    r = np.random.default_rng(1)
    rows = [sorted({*r.choice(m.ids, k).tolist(), *r.integers(0, 1 << toxicity.BITS, 5).tolist()}) for k in (0, 1, 2, 9, 20)] + [[]]
    assert np.allclose(m.logits(rows), [plain_logit(m, x) for x in rows])


def test_gradients_are_numeric():
    r = np.random.default_rng(2)
    w, v, y = r.normal(size=6), r.normal(size=(6, 3)), np.array([1.0, 0.0, 1.0])
    at, owner = np.array([0, 1, 3, 1, 4, 0, 3, 4]), np.array([0, 0, 0, 1, 1, 2, 2, 2])

    def loss(w, v, bias):
        m = toxicity.Machine(np.arange(6), w, v, bias)
        z = m.logits([at[owner == k] for k in range(3)])
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    met, gw, gv, gb = toxicity.gradients(w, v, 0.2, at, owner, y)
    e = 1e-6
    assert abs((loss(w, v, 0.2 + e) - loss(w, v, 0.2 - e)) / (2 * e) - gb) < 1e-5
    for k, f in enumerate(met):
        d = np.eye(6)[f] * e
        assert abs((loss(w + d, v, 0.2) - loss(w - d, v, 0.2)) / (2 * e) - gw[k]) < 1e-5
        for c in range(3):
            d = np.zeros((6, 3))
            d[f, c] = e
            assert abs((loss(w, v + d, 0.2) - loss(w, v - d, 0.2)) / (2 * e) - gv[k, c]) < 1e-5


def test_learns_pairs_that_sums_miss():
    """Each of three words is toxic beside its own group only; alone or beside another group it is not, nor is a group alone."""
    r = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(4_000):
        a, b = r.integers(0, 4), r.integers(0, 4)  # 3: none
        rows.append(sorted({100 + int(a), 200 + int(b)} - {103, 203} | set(r.integers(1_000, 3_000, 30).tolist())))
        labels.append(int(a == b < 3))
    wanted = np.array(labels[3_000:])
    pairs = toxicity.fit(rows[:3_000], labels[:3_000], screen=3)
    single = toxicity.fit(rows[:3_000], labels[:3_000], screen=3, group=1e9)
    assert not single.v.any()
    pairs, single = ((m.score(rows[3_000:]) >= 0.5).astype(int) for m in (pairs, single))
    assert (pairs == wanted).mean() > 0.97
    assert (single == wanted).mean() <= max(wanted.mean(), 1 - wanted.mean()) + 0.02


def test_long_harmless_texts_change_nothing():
    """An insult counts in a long text as in a short one."""
    rows = [[1, 2 + k % 5] if k % 3 == 0 else [2 + k % 5, 9 + k % 4] for k in range(600)]
    m = toxicity.fit(rows, [int(k % 3 == 0) for k in range(600)])
    assert m.score([[1, *range(1_000, 21_000)]])[0] == m.score([[1]])[0] > 0.5
    assert m.score([list(range(1_000, 21_000))])[0] < 0.5


def test_held_out_texts(spark):
    """The query against the labels it did not see, on the larger table."""
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES["op11_toxicity"](spark, d)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    clean, toxic = [r for r in held if r["toxic"] == 0], [r for r in held if r["toxic"] == 1]
    assert sum(r["predicted"] for r in clean) <= 0.005 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)  # some have no term that marks them


def test_query_like_plain(spark, sf):
    """The same by hand: rows of labels, terms, training, logits pair by pair."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out()).collect()
    frame = spark.createDataFrame([(docs[r["doc_id"]], r["toxic"]) for r in labels if r["doc_id"] in docs], "text string, label int")
    m = toxicity.train(frame)
    for r in registry.QUERIES["op11_toxicity"](spark, sf).collect():
        assert abs(r["score"] - 1 / (1 + np.exp(-plain_logit(m, toxicity.features(docs[r["doc_id"]]))))) < 1e-9


def test_edges(spark):
    """Null, empty, very long and repeated texts, clashing columns, no rows, no labels."""
    frame = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "Idiot " * 100_000), (4, "Idiot " * 100_000), (None, "idiot"), (5, "\ud83d\ude42 日本語")], "doc_id long, text string")
    ids = toxicity.features("idiot")
    m = toxicity.Machine(np.array(ids), np.full(len(ids), 2.0), np.zeros((len(ids), 4)), -1.0)
    clash = frame.withColumns({c: F.lit("other") for c in ("score", "held_out", "predicted", "label", "t", "y")})
    got = [(r["doc_id"], round(r["score"], 6)) for r in toxicity.score(clash, m).collect()]
    low, high = round(1 / (1 + np.exp(1.0)), 6), round(1 / (1 + np.exp(-(2.0 * len(ids) - 1))), 6)
    assert sorted(got, key=str) == sorted([(1, low), (2, low), (3, low), (4, high), (4, high), (None, high), (5, low)], key=str)
    none = spark.createDataFrame([], "text string, label int")
    assert toxicity.train(none).score([[]])[0] == 0.5
    one = spark.createDataFrame([("a", 1), ("b", 1), (None, None), ("c", 7)], "text string, label int")
    assert toxicity.train(one).score([[]])[0] > 0.98
    assert toxicity.score(frame.limit(0), m).count() == 0

"""Scans over ranges, counted pairs, and the block Lanczos solver, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lathework import frames
from lathework.frames import quantiles, running
from lathework.operators import cox, graph, lanczos, spectral, survival
from lathework.plans import catalog
from lathework.plans.base import vectors
from lathework.operators.cox_frame import fit_frame, slope


def chance(n, times, risks, seed, hot=False):
    r = np.random.default_rng(seed)
    t, e, k = r.integers(0, times, n).astype(float), r.random(n) < 0.5, r.integers(0, risks, n).astype(float)
    if hot:  # a third of all rows at one time, a third at one risk
        t[: n // 3], k[n // 4 : n // 4 + n // 3] = times // 2, risks // 2
    return t, e, k, np.where(r.random(n) < 0.7, "a", "b")


def frame(spark, t, e, k, g):
    rows = [(i, float(a), bool(b), float(c), str(d)) for i, (a, b, c, d) in enumerate(zip(t, e, k, g, strict=True))]
    return spark.createDataFrame([*rows, (None, None, True, 1.0, "a"), (None, 3.0, None, 1.0, "b")], "id long, time double, event boolean, risk double, grp string")


@pytest.mark.parametrize("per_range", [1_000_000, 7])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_like_pandas(spark, per_range, reverse):
    r = np.random.default_rng(1)
    rows = pd.DataFrame({"g": r.choice(["a", "b", None], 300), "o": r.permutation(300).astype(float), "v": r.integers(0, 9, 300).astype(float)})
    rows.loc[5, "v"] = np.nan
    own = spark.createDataFrame([tuple(None if x != x else x for x in v) for v in rows.itertuples(index=False)], "g string, o double, v double")
    got = running(own, ["g"], "o", {"s": "v", "n": F.lit(1)}, reverse, per_range)
    assert got.columns == ["g", "o", "v", "s", "n"]
    want = rows.fillna({"v": 0.0, "g": "-"}).sort_values("o", ascending=not reverse)
    want = want.assign(s=want.groupby("g")["v"].cumsum(), n=want.groupby("g").cumcount() + 1)
    assert {(x["o"], x["s"], x["n"]) for x in got.collect()} == set(want[["o", "s", "n"]].itertuples(index=False, name=None))
    assert running(own.limit(0), ["g"], "o", {"s": "v"}).count() == 0


def test_curves_do_not_depend_on_ranges(spark):
    own = frame(spark, *chance(400, 90, 9, 2))
    for of in (survival.life_table, survival.kaplan_meier):
        whole, cut = (sorted(tuple(np.round(x, 9) if isinstance(x, float) else x for x in r) for r in of(own, "grp", per_range=p).collect()) for p in (10**6, 11))
        assert whole == cut and len(whole) > 100
    whole, cut = (sorted(tuple(r) for r in survival._risk_sets(own, "grp", per_range=p).collect()) for p in (10**6, 11))
    assert whole == cut
    t, e, _, g = chance(400, 90, 9, 2)
    for time, name, d_g, n_g, d, n in cut:
        at, mine = t >= time, g == name
        assert (d_g, n_g, d, n) == (((t == time) & e & mine).sum(), (at & mine).sum(), ((t == time) & e).sum(), at.sum())


@pytest.mark.parametrize(("n", "times", "risks", "per_range"), [(300, 20, 10, 10), (500, 1_000, 1_000, 40), (400, 6, 300, 30), (400, 300, 3, 30), (1, 2, 2, 10), (600, 50, 50, 10**6)])
def test_concordance_counts_all_pairs(spark, n, times, risks, per_range):
    t, e, k, g = chance(n, times, risks, n, hot=n == 400)
    ok = survival.comparable(t, e, t, e)
    want = (float((ok & (k[:, None] > k)).sum() + 0.5 * (ok & (k[:, None] == k)).sum()), float(ok.sum()))
    assert tuple(survival.concordance(frame(spark, t, e, k, g), per_range=per_range).first())[:2] == want


def test_concordance_of_nothing(spark):
    own = spark.createDataFrame([], "id long, time double, event boolean, risk double")
    assert tuple(survival.concordance(own).first()) == (0.0, 0.0, None)


def test_dominated_like_plain():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 301):
        o, k, w, a = r.integers(0, 20, n), r.integers(0, 12, n), r.integers(0, 5, n), r.integers(0, 3, n)
        want = (a[:, None] * w * ((o > o[:, None]) & (k < k[:, None]))).sum()
        assert survival.dominated(o, k, w, a) == want


@pytest.mark.parametrize("n", [1, 40, 301])
def test_dominated_in_squares(n):
    """Many columns take products of stretches, not a running sum a bit; with pairs and equal risks as running sums."""
    r = np.random.default_rng(n)
    o, k, w, a = r.integers(0, 20, n), r.integers(0, 12, n), r.integers(0, 5, (n, survival.MANY)), r.integers(0, 3, (n, survival.MANY))
    after = o > o[:, None]
    for got, pairs in ((survival.dominated(o, k, w, a), after & (k < k[:, None])), (survival.later(o, k, w, a), after & (k == k[:, None])), (survival.later(o, 0 * k, w, a), after)):
        assert np.array_equal(got, (a * (pairs.astype(float) @ w)).sum(axis=0))


def test_draws_of_many_numbers(spark):
    """Draws made by the million are those of the hash in SQL."""
    b, k = np.array([0, 9, 10, 999, 7, 12]), np.array([0, 10, 9, 5_399_999, 99, 123_456])
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(b, k, strict=True)], "b int, k long")
    want = [r[0] for r in rows.select(frames.hash_draw(5_400_000, "seed", F.col("b"), F.col("k"))).collect()]
    assert frames.hash_draws("seed", b, k, 5_400_000).tolist() == want


def test_resamples_need_two_events(spark):
    """Of one event among many patients most resamples draw it less than twice."""
    rows = [(k, k, float(k), k == 0, float(-k)) for k in range(12)]
    own = spark.createDataFrame(rows, "id long, rank long, time double, event boolean, risk double")
    w = {r["rank"]: r["w"] for r in survival.multiplicities(spark, 12, 200).collect()}
    enough = {b for b, m in w[0].items() if m >= 2}
    got = survival.bootstrap_concordance(own, ["risk"], 200).collect()
    assert {r["b"] for r in got} <= enough and 0 < len(got) < 100 and all(r["c_risk"] == 1.0 for r in got)


def dense(edges):
    ids = sorted({i for i, _, _ in edges})
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for i, j, v in edges:
        w[at[i], at[j]] = v
    d = w.sum(axis=1)
    return ids, d, w / np.sqrt(d)[:, None] / np.sqrt(d)


def ring(parts, size, seed):
    """Rings of near neighbours with chance weights and, between rings, a weak edge or none."""
    r = np.random.default_rng(seed)
    out = {}
    for p in range(parts):
        for k in range(size):
            for step in (1, 2, 5):
                out[p * size + k, p * size + (k + step) % size] = 0.2 + r.random()
    return [(i, j, v) for (i, j), v in out.items()] + [(j, i, v) for (i, j), v in out.items()]


@pytest.mark.parametrize(("parts", "size", "bridge"), [(1, 150, False), (3, 60, False), (4, 40, True)])
def test_lowest_pairs_like_dense(spark, parts, size, bridge):
    """One ring; parts that are not connected (zero several times); weak bridges. Values, residuals, orthonormal vectors."""
    edges = ring(parts, size, parts)
    if bridge:
        edges += [(p * size, (p + 1) * size, 0.01) for p in range(parts - 1)] + [((p + 1) * size, p * size, 0.01) for p in range(parts - 1)]
    ids, d, n = dense(edges)
    found = lanczos.lowest_pairs(spark.createDataFrame(edges, "i long, j long, w double"), 6)
    assert np.abs(found.values - np.linalg.eigvalsh(np.eye(len(ids)) - n)[:6]).max() < 1e-6
    assert found.residuals.max() <= lanczos.SETTLED
    x = {r["id"]: r["vec"] for r in found.vectors.collect()}
    x = np.array([x[i] for i in ids])
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-9
    measured = np.linalg.norm(x - n @ x - x * found.values, axis=0)
    assert np.abs(measured - found.residuals).max() < 1e-8
    top = np.abs(x).argmax(axis=0)
    assert all(abs(x[t, c]) < 1e-6 or x[t, c] > 0 or np.isclose(np.abs(x[:, c]).max(), x[:, c].max(), atol=1e-5) for c, t in enumerate(top))


def test_small_graphs(spark):
    """Fewer samples than wanted pairs; a solver that may not go on long enough says so."""
    edges = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0)]
    found = lanczos.lowest_pairs(spark.createDataFrame(edges, "i long, j long, w double"), 12)
    assert np.allclose(found.values, np.linalg.eigvalsh(np.eye(3) - dense(edges)[2]))
    with pytest.raises(RuntimeError, match="residual"):
        lanczos.lowest_pairs(spark.createDataFrame(ring(1, 200, 5), "i long, j long, w double"), 6, max_blocks=1)


def test_neighbour_graph(spark):
    """Both directions, equal weights; the kernel of the definition on the nearest only."""
    r = np.random.default_rng(4)
    v = r.normal(size=(40, 3))
    own = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    got = {(x["i"], x["j"]): x["w"] for x in lanczos.neighbour_graph(own, 5).collect()}
    d = ((v[:, None] - v) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    mean = np.take_along_axis(d, near, 1).mean(axis=1)
    want = {(i, j) for i in range(40) for j in near[i]} | {(j, i) for i in range(40) for j in near[i]}
    assert got.keys() == want
    assert all(abs(w - np.exp(-d[i, j] / (2 * 0.5 * (mean[i] + mean[j] + d[i, j]) / 3))) < 1e-9 for (i, j), w in got.items())


def cohort(n, d, seed, ties):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    time = r.exponential(np.exp(-x[:, 0] + 0.5 * x[:, 1]))
    return x, np.ceil(time * 4) if ties else time, r.random(n) < 0.6


def cohort_frame(spark, x, t, e):
    return spark.createDataFrame([(float(a), bool(b), v.tolist()) for a, b, v in zip(t, e, x, strict=True)], "time double, event boolean, vec array<double>")


def test_slope_like_plain(spark):
    """Likelihood, gradient and Hessian against sums over risk sets by hand, whatever the ranges."""
    x, t, e = cohort(120, 3, 1, True)
    b = np.array([0.4, -0.3, 0.1])
    w = np.exp(x @ b)
    value, gradient, hessian = 0.0, np.zeros(3), np.zeros((3, 3))
    for k in np.flatnonzero(e):
        at = t >= t[k]
        mean = (w[at, None] * x[at]).sum(axis=0) / w[at].sum()
        value -= x[k] @ b - np.log(w[at].sum())
        gradient += mean - x[k]
        hessian += (w[at, None, None] * x[at, :, None] * x[at, None, :]).sum(axis=0) / w[at].sum() - np.outer(mean, mean)
    for per_range in (10**6, 5):
        got = slope(cohort_frame(spark, x, t, e), b, 120, per_range)
        assert np.isclose(got.value, value / 120) and np.allclose(got.gradient, gradient / 120) and np.allclose(got.hessian, hessian / 120)


@pytest.mark.parametrize(("alpha", "l1_ratio", "ties"), [(0.05, 0.01, True), (0.1, 0.9, False)])
def test_fit_frame_like_fit(spark, alpha, l1_ratio, ties):
    x, t, e = cohort(300, 5, 2, ties)
    want = cox.fit(x, t, e, alpha, l1_ratio, max_iter=5_000, tolerance=1e-11)
    got = fit_frame(cohort_frame(spark, x, t, e), alpha, l1_ratio, per_range=50)
    assert np.abs(got - want).max() < 1e-6 and (l1_ratio < 0.5 or (got == 0).any())


def test_fit_frame_edges(spark):
    x, t, e = cohort(30, 2, 3, True)
    assert not fit_frame(cohort_frame(spark, x, t, np.zeros(30, bool)), 0.1).any()
    assert len(fit_frame(cohort_frame(spark, x[:0], t[:0], e[:0]), 0.1)) == 0


@pytest.mark.parametrize("per_range", [10**6, 25])
def test_bootstrap_counts_all_pairs(spark, per_range):
    """Two risks, hot times and risks, ties; every replicate against all pairs of its resample."""
    t, e, k, _ = chance(240, 30, 25, 8, hot=True)
    other = np.random.default_rng(9).normal(size=240)
    own = spark.createDataFrame([(i, i, float(a), bool(b), float(c), float(o)) for i, (a, b, c, o) in enumerate(zip(t, e, k, other, strict=True))], "id long, rank long, time double, event boolean, risk double, other double")
    drawn = {r["rank"]: r["w"] for r in survival.multiplicities(spark, 240, 130).collect()}
    got = {r["b"]: (r["c_risk"], r["c_other"]) for r in survival.bootstrap_concordance(own, ["risk", "other"], 130, per_range=per_range).collect()}
    ok = survival.comparable(t, e, t, e)
    for b in range(130):
        w = np.array([drawn.get(i, {}).get(b, 0) for i in range(240)], float)
        pairs = ok * w[:, None] * w
        want = [float((pairs * ((x[:, None] > x) + 0.5 * (x[:, None] == x))).sum() / pairs.sum()) for x in (k, other)]
        assert np.allclose(got[b], want)


@pytest.mark.parametrize("per_range", [10**6, 6])
def test_quantiles_like_numpy(spark, per_range):
    """By group, with ties, a null group, a hot value, nulls; of everything; of nothing."""
    r = np.random.default_rng(6)
    v = np.where(r.random(400) < 0.3, 5.0, np.round(r.normal(size=400), 1))
    g = r.choice(["a", "b", "c"], 400)
    own = spark.createDataFrame([*[(None if k == "c" else str(k), float(x)) for k, x in zip(g, v, strict=True)], ("a", None), ("z", None)], "g string, v double")
    wanted = {"low": 0.025, "half": 0.5, "high": 0.99, "last": 1.0}
    got = {x["g"]: tuple(x)[1:] for x in quantiles(own, "v", wanted, ["g"], per_range).collect()}
    assert got.keys() == {"a", "b", None}
    for k, x in got.items():
        assert np.allclose(x, np.quantile(v[g == (k or "c")], list(wanted.values())))
    assert np.allclose(tuple(quantiles(own, "v", wanted, per_range=per_range).first()), np.quantile(v, list(wanted.values())))
    assert tuple(quantiles(own.limit(0), "v", {"x": 0.5}).first()) == (None,)


def test_harrell_counts_without_a_matrix_of_pairs():
    """200,000 patients: a matrix of pairs would be 40 GB. Ties in time and risk as counted pair by pair."""
    r = np.random.default_rng(8)
    t, e, risk = r.integers(0, 9, 150).astype(float), r.random(150) < 0.6, r.integers(0, 7, 150).astype(float)
    ok = survival.comparable(t, e, t, e)
    want = ((ok & (risk[:, None] > risk)).sum() + 0.5 * (ok & (risk[:, None] == risk)).sum()) / ok.sum()
    assert cox.harrell(risk, t, e) == pytest.approx(want, abs=1e-12)
    n = 200_000
    t = r.permutation(n).astype(float)
    assert cox.harrell(-t, t, np.ones(n, bool)) == 1.0


def test_cox_fit_settles_on_correlated_columns():
    """At the minimum the slope is within the penalty's bounds; a fit of 60,000 rows is a few passes."""
    r = np.random.default_rng(9)
    x = r.normal(size=(60_000, 6))
    x[:, 1] = x[:, 0] + 0.05 * x[:, 1]
    t, e = np.ceil(r.exponential(np.exp(-x[:, 0])) * 50), r.random(60_000) < 0.7
    b = cox.fit(x, t, e, 0.01, 0.01)
    g = (x * cox.gradient(x @ b, t, e)[0][:, None]).sum(axis=0) + 0.01 * 0.99 * b
    assert (np.abs(g) <= 0.01 * 0.01 + 1e-6).all()
    on = b != 0
    assert np.allclose(g[on], -0.01 * 0.01 * np.sign(b[on]), atol=1e-6)


def test_draws_are_packed(spark, monkeypatch):
    """The same draws as by rows, over several ranges of ranks and sorted pieces; what is shuffled is a row per range and replicate, not per draw."""
    monkeypatch.setattr(survival, "RANKS", 16)
    monkeypatch.setattr(survival, "SORTED", 500)
    want = {r["rank"]: r["w"] for r in survival.multiplicities(spark, 50, 40).collect()}
    got = {r["rank"]: list(r["w"]) for r in survival.counted_draws(spark, 50, 40).collect()}
    assert got == {k: [want.get(k, {}).get(b, 0) for b in range(40)] for k in range(50)}
    assert survival.counted_draws(spark, 1, 3).first()["w"] == b"\x01\x01\x01"


def test_basis_stays_bounded(spark):
    """More blocks than a basis holds: it is cut back, values and vectors stay those of the dense solver."""
    edges = ring(1, 600, 9)
    ids, _, n = dense(edges)
    found = lanczos.lowest_pairs(spark.createDataFrame(edges, "i long, j long, w double"), 4)
    want, axes = np.linalg.eigh(np.eye(600) - n)
    assert np.abs(found.values - want[:4]).max() < 1e-6 and found.residuals.max() <= lanczos.SETTLED
    x = {r["id"]: r["vec"] for r in found.vectors.collect()}
    x = np.array([x[i] for i in ids])
    assert np.abs(x.T @ x - np.eye(4)).max() < 1e-9
    assert np.linalg.norm(x - n @ x - x * found.values, axis=0).max() < 2 * lanczos.SETTLED


def test_kernel_pairs_like_dense(spark):
    """Eigenpairs of the kernel of all pairs without its matrix."""
    r = np.random.default_rng(8)
    v = np.vstack([r.normal(c, 1, (50, 4)) for c in (0, 2, 5)])
    own = spark.createDataFrame([(7 * i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    w = spectral.kernel_matrix(v, 20)
    found, _ = lanczos.kernel_pairs(graph.Kernel(own, 20), 6, lanczos.KERNEL_SETTLED)
    assert np.abs(found.values - spectral.spectrum(w)[:6]).max() < 1e-9
    for first, want in ((True, spectral.first_vectors(w, 4)), (False, spectral.embed(w, 4))):
        got = {x["id"]: x["vec"] for x in lanczos.kernel_vectors(graph.Kernel(own, 20), 4, first).collect()}
        assert np.abs(np.array([got[7 * i] for i in range(150)]) - want).max() < 1e-5


def test_spectral_queries_beyond_dense(spark, sf, monkeypatch):
    """Beyond the dense bound no query raises; what they return is what the matrix gives."""
    names = ("eigengap_k", "spectral_embedding", "early_integration", "spectral_clustering")
    want = {n: catalog.QUERIES[n](spark, sf).toPandas() for n in names}
    monkeypatch.setattr(spectral, "MAX_SAMPLES", 100)
    got = {n: catalog.QUERIES[n](spark, sf).toPandas() for n in names}
    assert got["eigengap_k"]["k"][0] == want["eigengap_k"]["k"][0]
    a, b = (x["spectral_embedding"].sort_values("id") for x in (got, want))
    assert list(a["id"]) == list(b["id"]) and a["vec"].map(len).eq(50).all()
    assert np.abs(np.array(a["vec"].tolist())[:, :9] - np.array(b["vec"].tolist())[:, :9]).max() < 1e-4
    # groups are as tight as those of the local k-means on the same vectors
    v = np.array([x["vec"] for x in sorted(vectors(spark, sf).collect())], float)
    w, pc = spectral.kernel_matrix(v), {r["id"]: r["pc"] for r in spectral.principal_components(vectors(spark, sf), 64, 50)[0].collect()}
    merged = spectral.kernel_matrix(np.array([pc[i] for i in sorted(pc)]))
    for n, m, c, k in [("early_integration", merged, "label", 2), *[("spectral_clustering", w, f"cluster_k{k}", k) for k in range(2, 7)]]:
        x, spread = spectral.first_vectors(m, k), []
        for found in (got, want):
            label = found[n].sort_values("id")[c].to_numpy()
            assert len(label) == len(x) and set(label) == set(range(k))
            spread.append(sum(((x[label == q] - x[label == q].mean(axis=0)) ** 2).sum() for q in range(k)))
        assert spread[0] <= 1.02 * spread[1], (n, c, spread)

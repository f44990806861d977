"""Solvers and dense methods against hand-made cases and properties."""

import numpy as np
import pandas as pd
import pytest

from lathework.operators import cox, graph, spectral, survival
from lathework.operators import matrix as M
from lathework.operators.tests import chi2_tail


def data(n=200, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    t, c = r.exponential(np.exp(-x @ [1.0, -0.5, 0])), r.exponential(1.5, n)
    return x, np.round(np.minimum(t, c), 2), t <= c


def test_gradient_is_the_derivative():
    x, t, e = data()
    eta = x @ [0.3, 0.2, -0.1]
    g, h = cox.gradient(eta, t, e)
    for k in range(6):
        up, down = eta.copy(), eta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert -(cox.log_likelihood(up, t, e) - cox.log_likelihood(down, t, e)) / 2e-5 == pytest.approx(g[k], abs=1e-7)
    assert (h > 0).all()


def test_fit_recovers_signs_and_shrinks():
    x, t, e = data(400)
    b = cox.fit(x, t, e, 1e-4)
    assert b[0] > 0.7 and b[1] < -0.3 and abs(b[2]) < 0.25
    assert np.abs(cox.fit(x, t, e, 100.0)).max() < 0.01
    assert not cox.fit(x, t, np.zeros(400, bool), 0.1).any()


def test_concordance_properties():
    x, t, e = data()
    risk = x[:, 0]
    assert cox.harrell(risk, t, e) + cox.harrell(-risk, t, e) == pytest.approx(1)
    assert cox.harrell(np.zeros(len(t)), t, e) == 0.5
    assert np.isnan(cox.harrell(risk, t, np.zeros(len(t), bool)))


def test_distributed_concordance_equals_plain(spark):
    x, t, e = data()
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(t)), "time": t, "event": e, "risk": x[:, 0], "rank": np.arange(len(t))}))
    assert survival.concordance(rows, per_range=20).first()["c"] == pytest.approx(cox.harrell(x[:, 0], t, e))
    boot = survival.bootstrap_concordance(rows.withColumn("same", rows["risk"]), ["risk", "same"], 40)
    assert boot.count() == 40
    delta = survival.delta_interval(boot, "risk", "same").first()
    assert delta["mean"] == 0 and not delta["ci_excludes_zero"]


def test_chi2_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(11.070497693516351, 5) == pytest.approx(0.05)
    assert chi2_tail(0, 3) == 1 and chi2_tail(1000, 1) < 1e-100


def blocks(n=12):
    w = np.full((2 * n, 2 * n), 0.01)
    w[:n, :n] = w[n:, n:] = 1
    np.fill_diagonal(w, 0)
    return w


def test_spectral_finds_blocks():
    w = blocks()
    labels = spectral.spectral_labels(w, 2)
    assert list(labels) == [0] * 12 + [1] * 12
    assert spectral.eigengap(spectral.spectrum(w)) == 2
    assert spectral.silhouette_scores(w, labels, 2) > 0.95
    assert spectral.clustering_record(w, 2, labels)["stability_mean"] == 1


def test_fusion_is_equivariant_and_order_free():
    r = np.random.default_rng(1)
    a, b = (spectral.kernel_matrix(r.normal(size=(20, 5)), 5) for _ in range(2))
    p = r.permutation(20)
    whole = spectral.fuse([a, b], 5, 4)
    assert np.allclose(spectral.fuse([b, a], 5, 4), whole)
    assert np.allclose(spectral.fuse([a[np.ix_(p, p)], b[np.ix_(p, p)]], 5, 4), whole[np.ix_(p, p)])
    assert np.allclose(whole, whole.T)


def test_kernel_bounds_and_scale_invariance(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(15, 4))
    make = lambda x: spark.createDataFrame(pd.DataFrame({"id": np.arange(15), "vec": x.tolist()}))
    one, two = (graph.affinity(graph.pair_distances(make(x)), 4).orderBy("i", "j").toPandas() for x in (v, 3 * v))
    assert np.allclose(one["w"], two["w"]) and one["w"].between(np.exp(-3), 1).all()
    dense = spectral.kernel_matrix(v, 4)
    assert np.allclose(one["w"], dense[one["i"], one["j"]])


def test_fusion_step_equals_dense(spark):
    r = np.random.default_rng(3)
    ids = np.arange(8)
    mats = [spectral.kernel_matrix(r.normal(size=(8, 3)), 3) for _ in range(2)]
    edges = [spectral.to_edges(spark, ids, m) for m in mats]
    step = graph.fuse_step(graph.transition(edges[1]), graph.local_transition(edges[0], 3)).toPandas()
    p = mats[1] / (2 * mats[1].sum(axis=1, keepdims=True)) + 0.5 * np.eye(8)
    s = np.zeros((8, 8))
    for k in range(8):
        top = np.argsort(-mats[0][k], kind="stable")[:3]
        s[k, top] = mats[0][k, top] / mats[0][k, top].sum()
    assert np.allclose(step["p"], (s @ p @ s.T)[step["i"], step["j"]])


def test_principal_components(spark):
    x = np.random.default_rng(4).normal(size=(50, 6)) @ np.diag([5, 3, 1, 1, 1, 1]) + 7
    scores, ratio = spectral.principal_components(spark.createDataFrame(pd.DataFrame({"id": np.arange(50), "vec": x.tolist()})), 6, 2)
    got = np.array(scores.orderBy("id").toPandas()["pc"].tolist())
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    assert ratio == pytest.approx(s[:2] ** 2 / (s**2).sum())


def test_wide_principal_components(spark):
    x = np.random.default_rng(7).normal(size=(40, 1500)) * np.linspace(3, 0.1, 1500) + 2
    scores, ratio = spectral.principal_components(spark.createDataFrame(pd.DataFrame({"id": np.arange(40), "vec": x.tolist()})), 1500, 5)
    got = np.array(scores.orderBy("id").toPandas()["pc"].tolist())
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :5] * s[:5])) and ratio == pytest.approx(s[:5] ** 2 / (s**2).sum())


def dense_combat(x, batch, mean_only=False):
    """Features by samples, priors over all features of a batch, iterated far."""
    groups = [batch == b for b in np.unique(batch)]
    grand = x.mean(axis=1, keepdims=True)
    resid = np.concatenate([x[:, g] - x[:, g].mean(axis=1, keepdims=True) for g in groups], axis=1)
    sd = np.sqrt((resid**2).mean(axis=1, keepdims=True))
    z, out = (x - grand) / sd, np.empty_like(x)
    for g in groups:
        own, n = z[:, g], g.sum()
        gamma = own.mean(axis=1)
        g_bar, t2 = gamma.mean(), gamma.var(ddof=1)
        if mean_only:
            out[:, g] = own - ((n * t2 * gamma + g_bar) / (n * t2 + 1))[:, None]
            continue
        delta = own.var(axis=1, ddof=1)
        m, s2 = delta.mean(), delta.var(ddof=1)
        a, b = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
        star, scale = gamma, delta
        for _ in range(500):
            star = (n * t2 * gamma + scale * g_bar) / (n * t2 + scale)
            scale = (b + 0.5 * ((own - star[:, None]) ** 2).sum(axis=1)) / (n / 2 + a - 1)
        out[:, g] = (own - star[:, None]) / np.sqrt(scale)[:, None]
    return out * sd + grand


def test_eigengap_looks_at_ten_gaps():
    assert spectral.eigengap(np.array([0, *np.linspace(0.1, 0.2, 10), 0.9, 0.95])) == 11
    assert spectral.eigengap(np.array([0, 0.1, 0.8, 0.85, 0.9])) == 2


def test_clustering_record_is_whole():
    w = blocks()
    ref = np.repeat([0, 1], 12)
    time = np.concatenate([np.arange(1, 13), np.arange(21, 33)]).astype(float)
    time[3] = np.nan
    r = spectral.clustering_record(w, 2, ref, 10, (time, np.ones(24, bool)))
    assert r["nmi"] == pytest.approx(1) and r["ari"] == 1 and r["logrank_p"] < 1e-4
    assert spectral.shared_information(ref, np.tile([0, 1], 12)) == pytest.approx(0, abs=1e-12)
    # by hand: four patients, two groups
    p = spectral.group_survival_p(np.array([0, 0, 1, 1]), np.array([1.0, 2, 3, 4]), np.array([True, True, True, False]))
    u, v = 2 - (2 / 4 + 1 / 3), 1 / 4 + 2 / 9
    assert p == pytest.approx(chi2_tail(u * u / v, 1))


def test_inner_folds_need_two_events():
    x, t, _ = data(30)
    few = np.zeros(30, bool)
    few[:3] = True
    assert cox.tuned_fold(x, t, few, x, alphas=(0.01, 10.0), inner=3)[1] in (0.01, 10.0, cox.FALLBACK)
    few[1:] = False
    assert cox.tuned_fold(x, t, few, x, alphas=(0.01, 10.0))[1] == cox.FALLBACK


def test_combat_removes_batch_means(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 30))
    x[:, :15] += 4
    batch = np.repeat([0, 1], 15)
    long = spark.createDataFrame(pd.DataFrame({"sample_id": np.tile(np.arange(30), 40), "feature_id": np.repeat(np.arange(40), 30), "value": x.ravel()}))
    batches = spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(30), "batch": batch}))
    for parts in (1, 7):
        got = spectral.combat(long.repartition(parts), batches).toPandas().pivot(index="feature_id", columns="sample_id", values="value").to_numpy()
        assert np.allclose(got, dense_combat(x, batch), rtol=1e-6)
    assert abs(got[:, :15].mean() - got[:, 15:].mean()) < 0.1
    lone = np.where(np.arange(30) == 29, 2, batch)
    alone = spectral.combat(long, spark.createDataFrame(pd.DataFrame({"sample_id": np.arange(30), "batch": lone}))).toPandas().pivot(index="feature_id", columns="sample_id", values="value").to_numpy()
    assert np.allclose(alone, dense_combat(x, lone, True), rtol=1e-6)
    shifted = spectral.mean_shift(long, batches).join(batches, "sample_id").groupBy("batch").avg("value").toPandas()["avg(value)"]
    assert shifted.max() - shifted.min() < 1e-9


def test_zero_counts_without_a_grid(spark):
    long = spark.createDataFrame([(1, "a", 4.0), (2, "a", 2.0), (3, "b", 8.0), (1, "b", 1.0), (2, "b", 5.0)], "sample_id int, feature_id string, value double")
    implicit = {r["feature_id"]: r["mad"] for r in M.median_absolute_deviation(long, 3).collect()}
    explicit = {r["feature_id"]: r["mad"] for r in M.median_absolute_deviation(M.densify(long, 0.0)).collect()}
    assert implicit == explicit == {"a": 2.0, "b": 3.0}


def test_nearest_blocked_equals_pairs(spark):
    v = np.random.default_rng(6).normal(size=(40, 5))
    own = spark.createDataFrame(pd.DataFrame({"id": np.arange(40), "vec": v.tolist()}))
    for metric in ("sqeuclidean", "cosine"):
        a = {(r["i"], r["j"]) for r in graph.nearest_blocked(own, 4, 5, metric).collect()}
        b = {(r["i"], r["j"]) for r in graph.nearest(graph.pair_distances(own, metric), 4).collect()}
        assert a == b
    with pytest.raises(Exception):
        graph.pair_distances(own, "other").count()


def test_cross_validation(spark):
    x, t, e = data(120)
    rows = spark.createDataFrame(pd.DataFrame({"method": "m", "id": np.arange(120), "time": t, "event": e, "vec": x.tolist()}))
    folds = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "seed": 0, "fold": np.arange(120) % 3}))
    oof = cox.cross_validate(rows, folds, (0.01, 1.0))
    assert oof.count() == 120
    got = cox.summary(cox.fold_scores(oof.unionByName(cox.late_average(oof).selectExpr("method", "seed", "fold", "id", "risk", "cast(null as double) alpha")), rows)).collect()
    assert {r["method"] for r in got} == {"m", "late_average"} and all(r["fold_mean"] > 0.65 for r in got)


def test_fold_of_stretches(monkeypatch):
    """A cohort in stretches of rows gives the slope of the whole, masked rows as if they were not there, and the fold's matrix is not copied."""
    r = np.random.default_rng(8)
    n, d = 500, 3
    x, t, e, keep = r.normal(size=(n, d)), r.integers(0, 90, n).astype(float), r.random(n) < 0.4, r.random(n) < 0.7
    b = r.normal(size=d) / 4
    monkeypatch.setattr(cox, "ROWS", 40)
    own = cox._Cohort.of(x, t, e)
    order = np.argsort(t, kind="stable")
    assert len(own.stretches) > 5
    for mask, rows in ((None, np.ones(n, bool)), (keep[order], keep)):
        at = own.slope(b, mask)
        g, _ = cox.gradient(x[rows] @ b, t[rows], e[rows])
        assert at.value == pytest.approx(-cox.log_likelihood(x[rows] @ b, t[rows], e[rows]), abs=1e-12)
        assert np.allclose(at.gradient, x[rows].T @ g, atol=1e-12)
        step = 1e-5
        near = [(own.slope(b + step * v, mask).gradient - own.slope(b - step * v, mask).gradient) / (2 * step) for v in np.eye(d)]
        assert np.allclose(at.hessian, near, atol=1e-6)
    assert np.allclose(own.fit(0.1, keep=keep[order]), cox.fit(x[keep], t[keep], e[keep], 0.1), atol=1e-9)

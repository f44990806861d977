"""Krylov principal components against dense decompositions, on dense vectors and on cells."""

import numpy as np
import pandas as pd
import pytest

from lathework.operators import components, matrix
from lathework.plans import catalog
from lathework.session import materialize


def frame(spark, x):
    own = pd.DataFrame({"id": np.arange(len(x)), "vec": x.tolist()})
    return materialize(spark.createDataFrame(own, "id long, vec array<double>").repartition(5), "vectors")


@pytest.mark.parametrize("n, d, c", [(120, 15_000, 50), (400, 1_100, 20), (30, 40, 10), (500, 6, 6)])
def test_components_equal_svd(spark, n, d, c):
    r = np.random.default_rng(d)
    # a slowly falling spectrum below the signal, and a mean far from zero
    x = r.normal(size=(n, 12)) @ r.normal(size=(12, d)) * 2 + r.normal(size=(n, d)) + 30
    found = components.krylov(frame(spark, x), d, c)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert found.residuals.max() <= components.SETTLED
    assert np.allclose(found.ratio, s[:c] ** 2 / (s**2).sum(), rtol=1e-9)
    cosines = np.linalg.svd(vt[:c] @ found.axes, compute_uv=False)
    assert cosines.min() > 1 - 1e-9 and np.allclose(found.axes.T @ found.axes, np.eye(c), atol=1e-10)
    got = np.array(found.scores.orderBy("id").toPandas()["pc"].tolist())
    assert np.allclose(np.abs(got[:, :5]), np.abs(u[:, :5] * s[:5]), atol=1e-4)
    assert (got[np.abs(np.round(got, 6)).argmax(axis=0), np.arange(c)] > 0).all()


def test_components_of_few_samples(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(4, 50))
    found = components.krylov(frame(spark, x), 50, 10)
    assert len(found.ratio) == 3 and found.ratio.sum() == pytest.approx(1)
    one = components.krylov(frame(spark, x[:1]), 50, 10)
    assert [tuple(v) for v in one.scores.collect()] == [(0, [])]
    none = components.krylov(frame(spark, x).limit(0), 50, 10)
    assert none.scores.count() == 0 and len(none.ratio) == 0
    same = components.krylov(frame(spark, np.ones((6, 20))), 20, 3)
    assert np.allclose(np.array(same.scores.toPandas()["pc"].tolist()), 0) and np.allclose(same.ratio, 0)
    with pytest.raises(Exception, match="other than 49"):
        components.krylov(frame(spark, x), 49, 2)
    with pytest.raises(ValueError, match="a basis takes"):
        components.krylov(frame(spark, x), components.MAX_BASIS, 2)


def test_components_of_cells(spark):
    r = np.random.default_rng(3)
    x = np.where(r.random((90, 300)) < 0.1, r.normal(size=(90, 300)) + 2, 0)
    x[7] = 0
    i, j = (v.tolist() for v in np.indices(x.shape).reshape(2, -1))
    long = spark.createDataFrame(list(zip(i, j, [v if v else None for v in x.ravel().tolist()], strict=True)), "sample_id long, feature_id long, value double")
    cells = materialize(matrix.to_cells(long).withColumnRenamed("sample_id", "id"), "cells")
    assert cells.where("id = 7").first()["at"] == []
    found, dense = components.krylov(cells, 300, 8), components.krylov(frame(spark, x), 300, 8)
    assert np.allclose(found.ratio, dense.ratio) and cells.count() == 90
    a, b = (np.array(f.scores.orderBy("id").toPandas()["pc"].tolist()) for f in (found, dense))
    assert np.allclose(a, b, atol=1e-5)


def test_cells(spark):
    rows = [(1, 3, 5.0), (1, 0, 2.0), (2, 4, 0.0), (3, 2, None)]
    long = spark.createDataFrame(rows, "sample_id long, feature_id long, value double")
    assert {tuple(map(str, r)) for r in matrix.to_cells(long).collect()} == {("1", "[0, 3]", "[2.0, 5.0]"), ("2", "[]", "[]"), ("3", "[]", "[]")}


def test_components_of_samples_equal_svd(spark, monkeypatch):
    """Features beyond the basis' limit: the samples' side gives the same components, in several blocks and slices."""
    monkeypatch.setattr(components, "SLICE", 100)
    r = np.random.default_rng(4)
    x = np.where(r.random((70, 900)) < 0.2, r.normal(size=(70, 900)) + 3, 0) * np.linspace(1, 3, 70)[:, None]
    x[7] = 0
    i, j = np.indices(x.shape).reshape(2, -1)
    long = spark.createDataFrame(pd.DataFrame({"sample_id": i * 3, "feature_id": j * 5, "value": x.ravel()}))
    cells = materialize(matrix.to_cells(long).withColumnRenamed("sample_id", "id"), "cells")
    found = components.of_cells(cells, 6, blocks=5)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert found.residuals.max() <= components.SIDE_SETTLED
    assert np.allclose(found.ratio, s[:6] ** 2 / (s**2).sum(), rtol=1e-9)
    rows = found.scores.orderBy("id").collect()
    got = np.array([r["pc"] for r in rows])
    assert [r["id"] for r in rows] == list(range(0, 210, 3))
    assert np.allclose(np.abs(got), np.abs(u[:, :6] * s[:6]), atol=1e-4)
    assert (got[np.abs(np.round(got, 6)).argmax(axis=0), np.arange(6)] > 0).all()
    assert components.of_cells(cells.limit(0), 3).scores.count() == 0
    assert [r["pc"] for r in components.of_cells(cells.where("id < 6"), 5).scores.collect()] and len(components.of_cells(cells.where("id < 6"), 5).ratio) == 1


def test_wide_query_beyond_the_basis(spark, sf, monkeypatch):
    """More parts than a basis takes are no error, and the components are the same."""
    want = {r["id"]: r["pc"] for r in catalog.QUERIES["wide_components"](spark, sf).collect()}
    monkeypatch.setattr(components, "MAX_BASIS", 1)
    got = {r["id"]: r["pc"] for r in catalog.QUERIES["wide_components"](spark, sf).collect()}
    assert got.keys() == want.keys()
    a, b = (np.array([x[k] for k in sorted(x)]) for x in (got, want))
    k = min(a.shape[1], 3)
    assert np.allclose((a**2).sum(axis=0), (b**2).sum(axis=0)[: a.shape[1]], rtol=1e-6) and np.allclose(a[:, :k], b[:, :k], atol=1e-3)

"""All eigenvalues by panels, band and counting against the dense solver."""

import numpy as np
import pandas as pd
import pytest

from lathework.operators import dense_spectrum, graph, spectral
from lathework.plans import catalog


@pytest.mark.parametrize("n, b", [(2, 1), (3, 2), (41, 13), (40, 7), (50, 1)])
def test_band_to_three_diagonals(spark, n, b):
    r = np.random.default_rng(n)
    a = r.normal(size=(n, n))
    i, j = np.indices((n, n))
    a = np.where(abs(i - j) <= b, a + a.T, 0)
    band = np.array([np.pad(np.diag(a, -q), (0, q)) for q in range(b + 1)]).T
    d, e = dense_spectrum.to_three(band)
    got = dense_spectrum.by_counting(spark, d, e).toPandas().sort_values("idx")
    assert got["idx"].tolist() == list(range(n)) and np.abs(got["value"] - np.linalg.eigvalsh(a)).max() < 1e-12


@pytest.mark.parametrize("width", [8, 11, 64])
def test_all_eigenvalues(spark, width):
    """Copies of samples make equal eigenvalues; a last panel with fewer rows; one panel only."""
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 5))
    x[40:] = x[7]
    own = spark.createDataFrame(pd.DataFrame({"id": np.arange(60) * 3, "vec": x.tolist()}))
    got = dense_spectrum.kernel_spectrum(graph.Kernel(own, 6), width).toPandas().sort_values("idx")
    assert np.abs(got["value"].to_numpy() - spectral.spectrum(spectral.kernel_matrix(x, 6))).max() < 1e-12


def test_laplacian_spectrum_beyond_dense(spark, sf, monkeypatch):
    """Beyond the dense bound all eigenvalues come, with the same columns."""
    want = catalog.QUERIES["laplacian_spectrum"](spark, sf).toPandas()
    monkeypatch.setattr(spectral, "MAX_SAMPLES", 100)
    got = catalog.QUERIES["laplacian_spectrum"](spark, sf).toPandas().sort_values("idx")
    assert list(got.dtypes.items()) == list(want.dtypes.items()) and got["idx"].tolist() == want["idx"].tolist()
    assert np.abs(got["value"].to_numpy() - want["value"].to_numpy()).max() < 1e-11

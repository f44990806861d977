"""Registered queries run the whole of their job, not a smaller one."""

import pytest

from lathework.operators import cox as C
from lathework.operators import spectral as L
from lathework.plans import catalog


def test_bootstrap_replicates(spark, sf):
    """Intervals rest on 1,000 resamples."""
    for name in ("bootstrap_ci", "bootstrap_delta"):
        assert catalog.QUERIES[name](spark, sf).first()["n"] == 1_000


class Enough(Exception):
    pass


def test_cox_seeds_and_penalties(spark, sf, monkeypatch):
    """Five seeds and the default grid of penalties; out-of-fold risks of seed 2."""
    asked = {}

    def cross_validate(rows, folds, alphas=C.ALPHAS, impute=0):
        asked["now"] = ({r["seed"] for r in folds.select("seed").distinct().collect()}, tuple(alphas))
        raise Enough

    monkeypatch.setattr(C, "cross_validate", cross_validate)
    for name, seeds in {"cox_cross_validation": set(range(5)), "cox_late_concat": set(range(5)), "cox_covariate_adjusted": set(range(5)), "cox_oof_bootstrap": {2}}.items():
        with pytest.raises(Enough):
            catalog.QUERIES[name](spark, sf)
        assert asked.pop("now") == (seeds, (0.01, 0.1, 1.0, 10.0, 100.0)), name


def test_k_selection_seeds(spark, sf, monkeypatch):
    """Two groups are judged by ten seeds."""
    asked = {}

    def record(w, k, ref, seeds, survival=None):
        asked[k] = seeds
        return {"k": k, "silhouette": 0.0}

    monkeypatch.setattr(L, "clustering_record", record)
    catalog.QUERIES["k_selection"](spark, sf)
    assert asked[2] == 10

"""Universes past the dense limit: factors give the dense matrix."""

import datetime

import numpy as np
import pytest

from quantloom.operators import estimators as E
from quantloom.operators import forecast as X


@pytest.mark.parametrize("n", [12, 90])
def test_factors_give_the_dense_matrix(n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.02, (60, n)) + rng.normal(0, 0.01, (60, 1)) * rng.uniform(0.5, 1.5, n)
    y, a, v = E.shrunk_factors(x)
    want = E.shrinkage_cov(x)[0]
    np.testing.assert_allclose(y @ a @ y.T + np.diag(v), want, atol=1e-9)


def test_shrunk_covariances_past_the_dense_limit(spark):
    rng = np.random.default_rng(2)
    days = [datetime.date(2020, 1, 5) + datetime.timedelta(7 * i) for i in range(40)]
    rows = [(s, d, float(v)) for s in range(9) for d, v in zip(days, rng.normal(0, 0.02, 40), strict=True) if rng.random() < 0.9]
    r = spark.createDataFrame(rows, "symbol long, date date, ret double")
    dense, got = ({(x.a, x.b): x.cov for x in E.shrunk_covariances(r, most).collect()} for most in (2000, 3))
    assert set(got) == set(dense) and len(got) == 45
    assert all(got[k] == pytest.approx(dense[k], abs=1e-9) for k in dense)


def test_correlation_factors_give_the_dense_matrix():
    u = np.random.default_rng(4).normal(0.05, 1.1, (50, 7))
    y = X.dcc_factors(u, 0.03, 0.92)
    np.testing.assert_allclose(y @ y.T, X.dcc_path(u, 0.03, 0.92)[1], atol=1e-9)


@pytest.mark.parametrize("text", [False, True])
def test_joint_paths_past_the_dense_limit(spark, text):
    rng = np.random.default_rng(6)
    common = rng.normal(0, 0.02, 120)
    days = [datetime.date(2020, 1, 5) + datetime.timedelta(7 * i) for i in range(120)]
    name = (lambda s: f"T.{s}") if text else int
    rows = [(name(s), d, float(v)) for s in range(8) for d, v in zip(days, 0.002 + common + rng.normal(0, 0.01, 120), strict=True)]
    rows += [(name(8), d, 0.01) for d in days[:29]]
    r = spark.createDataFrame(rows, f"symbol {'string' if text else 'long'}, date date, ret double")
    dense, got = ({x.symbol: x for x in X.joint_paths(r, sims=4000, most_assets=most).collect()} for most in (20, 3))
    assert set(got) == set(dense) and len(got) == 9
    for s, want in dense.items():
        for c in ("p05", "p50", "p95", "mean"):
            assert got[s][c] == pytest.approx(want[c], abs=0.012), (s, c)
    again = {x.symbol: x for x in X.joint_paths(r.repartition(3), sims=4000, most_assets=3).collect()}
    assert all(again[s][c] == pytest.approx(got[s][c], abs=1e-9) for s in got for c in ("p05", "p50", "p95", "mean"))

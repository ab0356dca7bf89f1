"""Pairs of symbols: many small blocks and tiles give what pandas gives over all pairs, and one row a symbol and block is shuffled."""

import datetime

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import forecast as X
from quantloom.operators import metrics as M

DAYS = [datetime.date(2020, 1, 5) + datetime.timedelta(7 * i) for i in range(50)]


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.02, (50, 23)) + rng.normal(0, 0.01, (50, 1))
    x[rng.random(x.shape) < 0.25] = np.nan
    return pd.DataFrame(x, index=DAYS)


@pytest.fixture(scope="module")
def returns(spark, wide):
    rows = [(int(s), d, None if np.isnan(v) else float(v)) for s in wide for d, v in wide[s].items()]
    return spark.createDataFrame(rows, "symbol long, date date, ret double")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(M, "PAIR_BLOCK", 4)
    monkeypatch.setattr(M, "PAIR_MOST", 6)
    monkeypatch.setattr(M, "PAIR_TILE", 3)


def best(wide, k, least=30):
    c, n = wide.corr(), wide.notna().astype(int).T @ wide.notna().astype(int)
    out = {}
    for s in wide:
        ok = [d for d in wide if d != s and n.loc[s, d] >= least]
        out[s] = sorted(ok, key=lambda d: (-abs(c.loc[s, d]), d))[:k]
    return c, out


def test_covariances_over_blocks(spark, returns, wide, small):
    got = M.covariances(returns).toPandas()
    cov, corr = wide.cov(), wide.corr()
    assert len(got) == 23 * 24 // 2 == len(got.drop_duplicates(["a", "b"])) and (got["a"] <= got["b"]).all()
    for r in got.itertuples():
        assert r.cov == pytest.approx(cov.loc[r.a, r.b], abs=1e-12) and r.corr == pytest.approx(corr.loc[r.a, r.b], abs=1e-9)
        assert r.n == (wide[r.a].notna() & wide[r.b].notna()).sum()


def test_neighbours_over_blocks(spark, returns, wide, small):
    corr, want = best(wide, 3, 25)
    got = X.neighbours(returns, 3, 25).toPandas()
    assert {s: set(x["dst"]) for s, x in got.groupby("src")} == {s: set(d) for s, d in want.items() if d}
    assert all(r.rho == pytest.approx(corr.loc[r.src, r.dst], abs=1e-9) for r in got.itertuples())
    assert got.groupby("src")["weight"].sum().round(9).eq(1).all()


def test_equal_correlations_in_order_of_symbols(spark, small):
    x = np.random.default_rng(1).integers(-4, 5, 40) / 64.0
    rows = [(s, d, float(v)) for s in range(9) for d, v in zip(DAYS, x, strict=False)]
    got = X.neighbours(spark.createDataFrame(rows, "symbol long, date date, ret double"), 2).toPandas()
    assert {s: sorted(y["dst"]) for s, y in got.groupby("src")} == {s: [d for d in range(9) if d != s][:2] for s in range(9)}


def test_holdings_risk_makes_no_pairs(spark, returns, wide, small, monkeypatch):
    w = [("a", s, 1.0 / (s + 1)) for s in range(14)] + [("b", s, float(s)) for s in range(9, 23)] + [("c", 99, 1.0)]
    weights = spark.createDataFrame(w, "holdings string, symbol long, weight double")
    monkeypatch.setattr(M, "covariances", None)
    got = {r.holdings: r.volatility for r in M.holdings_risk(weights, returns).collect()}
    assert set(got) == {"a", "b"}
    for h in got:
        own = pd.Series({s: v for g, s, v in w if g == h})
        assert got[h] == pytest.approx(np.sqrt(own @ wide[own.index].cov() @ own), abs=1e-12)


def test_peer_means_of_whole_histories(spark, returns, wide, small):
    groups = spark.createDataFrame([(s, s % 2) for s in range(23)], "symbol long, grp long")
    got = X.peer_features(returns, groups, 3).toPandas().set_index(["symbol", "date"])
    _, want = best(wide, 3)
    assert len(got) == wide.size
    for s in wide:
        mine = got.loc[s].sort_index()
        others = wide.drop(columns=s)
        same = others[[d for d in others if d % 2 == s % 2]]
        means = (wide[want[s]].mean(axis=1) if want[s] else others.mean(axis=1) * np.nan, others.mean(axis=1), same.mean(axis=1))
        for name, m in zip(("peers_l1", "market_l1", "group_mean_l1"), means, strict=True):
            np.testing.assert_allclose(mine[name].to_numpy(float), m.shift().to_numpy(), atol=1e-12)


def test_shuffles_arrays(spark, returns):
    plan = M.covariances(returns)._jdf.queryExecution().executedPlan().toString()
    assert "rets" in plan and "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan

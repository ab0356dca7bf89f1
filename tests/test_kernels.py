"""Kernels and functions against hand-computed values, pandas, and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.functions import grouped as G
from quantloom.functions import panel as P
from quantloom.functions import special as S
from quantloom.operators import align as A
from quantloom.operators import estimators as E
from quantloom.operators import forecast as X
from quantloom.operators import indicators as I
from quantloom.operators import joins as J
from quantloom.operators import holdings as O
from quantloom.operators import scores as C
from quantloom.operators import text as TX

RNG = np.random.default_rng(4)
PANEL = "symbol long, date date, close double"


def panel(spark, series: dict[int, list], start="2024-01-01"):
    days = pd.date_range(start, periods=max(map(len, series.values())))
    rows = [(s, d.date(), v) for s, vs in series.items() for d, v in zip(days, vs)]
    return spark.createDataFrame(rows, PANEL)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=30), st.floats(0.05, 0.95))
def test_ewm_equals_pandas(x, alpha):
    a = np.array([np.nan if v is None else v for v in x])
    s = pd.Series(a).ewm(alpha=alpha, adjust=False)
    np.testing.assert_allclose(G.ewm_mean(a, alpha), s.mean().to_numpy(), atol=1e-9)
    if not np.isnan(a).any():
        np.testing.assert_allclose(G.ewm_std(a, alpha)[1:], s.std().to_numpy()[1:], atol=1e-6)


def test_alpha():
    assert G.alpha_of(span=9) == 0.2 and abs(G.alpha_of(halflife=1) - 0.5) < 1e-12


def test_positions_with_lag_cooldown_and_conflicts():
    b = np.array([1, 0, 0, 1, 0, 0, 1, 0], bool)
    s = np.array([0, 1, 0, 0, 1, 0, 1, 0], bool)
    assert G.positions(b, s).tolist() == [1, -1, -1, 1, -1, -1, -1, -1]
    assert G.positions(b, s, mode="buy_wins").tolist()[-2:] == [1, 1]
    assert G.positions(b, s, mode="mutual").tolist()[-2:] == [-1, -1]
    assert G.positions(b, s, lag=1).tolist() == [0, 1, -1, -1, 1, -1, -1, -1]
    assert G.positions(b, s, cooldown=2).tolist() == [1, 1, 1, 1, 1, 1, -1, -1]


def test_unit_flips():
    x = np.array([1.0, 1.1, 110.0, 115.0, 1.2, np.nan, 0.012, 1.25])
    np.testing.assert_allclose(G.repair_unit_flips(x), [1.0, 1.1, 1.1, 1.15, 1.2, np.nan, 1.2, 1.25])


def test_special_functions(spark):
    assert abs(S.norm_ppf(0.975) - 1.959963984540054) < 1e-12 and S.norm_ppf(0.5) == 0
    assert abs(S.t_sf(2.0, 10) - 0.036694017385) < 1e-9 and abs(S.t_sf(-2.0, 10) - 0.963305982615) < 1e-9
    assert abs(S.gammainc_upper(2.5, 3.0) - 0.30621891841) < 1e-9
    assert abs(S.expected_max_normal(2) - 1 / math.sqrt(math.pi)) < 1e-6
    r = spark.range(1).select(S.ppf(F.lit(0.01)), S.ppf(F.lit(0.6)), S.cdf(F.lit(-1.5)), S.cdf(F.lit(0.3)), S.ppf(F.lit(0.995))).first()
    for got, want in zip(r, (S.norm_ppf(0.01), S.norm_ppf(0.6), 0.0668072013, 0.6179114222, S.norm_ppf(0.995)), strict=True):
        assert abs(got - want) < 3e-7


def test_panel_nulls(spark):
    df = panel(spark, {1: [1.0, None, 3.0, None, None, 6.0, None], 2: [None, 2.0]})
    w = P.over("symbol")
    got = P.interpolate(df, "close").orderBy("symbol", "date").collect()
    assert [r["close"] for r in got] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0, None, 2.0]
    rows = df.select("symbol", "date", P.ffill("close", w).alias("f"), P.bfill("close", w).alias("b"), P.clip(F.col("close"), 1.5, 4.0).alias("c"), P.rolling(F.avg, "close", w, 3, 2).alias("r")).filter("symbol = 1").orderBy("date").collect()
    assert [r["f"] for r in rows] == [1, 1, 3, 3, 3, 6, 6] and [r["b"] for r in rows] == [1, 3, 3, 6, 6, 6, None]
    assert [r["c"] for r in rows] == [1.5, None, 3.0, None, None, 4.0, None] and [r["r"] for r in rows] == [None, None, 2.0, None, None, None, None]
    one = spark.range(1).select(P.clean(F.lit(float("nan"))), P.clean(F.lit(float("inf"))), P.ratio(F.lit(1), F.lit(0)), P.signed_expm1(P.signed_log1p(F.lit(-2.5)))).first()
    assert one[:3] == (None, None, None) and abs(one[3] + 2.5) < 1e-12


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, "2024-01-10"), (1, "2024-02-01"), (2, "2024-01-01")], "symbol long, date string").withColumn("date", F.to_date("date"))
    right = spark.createDataFrame([(1, "2024-01-10", 5.0), (1, "2024-01-20", None), (1, "2023-12-01", 1.0), (3, "2024-01-01", 9.0)], "symbol long, date string, v double").withColumn("date", F.to_date("date"))
    got = {(r["symbol"], str(r["date"])): r["v"] for r in J.asof(left, right).collect()}
    assert got == {(1, "2024-01-10"): 5.0, (1, "2024-02-01"): None, (2, "2024-01-01"): None}
    got = {(r["symbol"], str(r["date"])): r["v"] for r in J.asof(left, right, tolerance_days=5).collect()}
    assert got[(1, "2024-01-10")] == 5.0 and got[(1, "2024-02-01")] is None
    near = {(r["symbol"], str(r["date"])): (r["mean"], r["n_mean"]) for r in J.range_mean(left, right.dropna(), "v", 40).collect()}
    assert near[(1, "2024-01-10")] == (3.0, 2) and near[(1, "2024-02-01")] == (5.0, 1) and near[(2, "2024-01-01")] == (None, None)


def test_end_at_cuts_and_carries(spark):
    df = panel(spark, {1: [1.0, 2.0, 3.0], 2: [4.0]})
    got = {(r["symbol"], str(r["date"])): r["close"] for r in A.end_at(df, F.lit("2024-01-02").cast("date"), ["close"]).collect()}
    assert got == {(1, "2024-01-01"): 1.0, (1, "2024-01-02"): 2.0, (2, "2024-01-01"): 4.0, (2, "2024-01-02"): 4.0}


def test_rsi_and_adx_follow_definitions():
    c = 50 + np.cumsum(RNG.normal(0, 1, 80))
    d = pd.Series(c).diff()
    up, dn = d.where(d > 0, 0.0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d.where(d < 0, 0.0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    np.testing.assert_allclose(I._rsi(c, 14), np.where(dn == 0, 100, 100 - 100 / (1 + up / dn)), atol=1e-9)
    h, lo = c + 1, c - 1
    s = lambda x: pd.Series(x)
    tr = pd.concat([s(h - lo), (s(h) - s(c).shift()).abs(), (s(lo) - s(c).shift()).abs()], axis=1).max(axis=1)
    ewm = lambda x: x.ewm(alpha=1 / 14, adjust=False).mean()
    um, dm = s(h).diff().clip(lower=0), (-s(lo).diff()).clip(lower=0)
    p, m = um.where(um > dm, 0.0), dm.where(dm > um, 0.0)
    dip, dim = 100 / ewm(tr) * ewm(p), 100 / ewm(tr) * ewm(m)
    np.testing.assert_allclose(I._adx(h, lo, c, 14), ewm(100 * (dip - dim).abs() / (dip + dim).replace(0, np.nan)), atol=1e-8)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0.01, 5), min_size=3, max_size=14), st.integers(1, 3))
def test_capped_weights(raw, split):
    raw = np.array(raw) / np.sum(raw)
    cap = max(0.10, 1 / len(raw))
    mask = np.arange(len(raw)) < split
    w = C.capped_weights(raw, cap, [(mask, 0.3)] if not mask.all() else [])
    assert abs(w.sum() - 1) < 1e-6 and (w >= -1e-12).all() and w.max() <= cap + 1e-6
    if not mask.all():
        assert w[mask].sum() <= max(0.3, 1 - (~mask).sum() * cap) + 1e-6


def test_solvers_keep_limits():
    r = RNG.normal(0.002, 0.02, (150, 10)) + RNG.normal(0, 0.01, (150, 1))
    sigma, w = E.shrinkage_cov(r)
    assert np.linalg.eigvalsh(sigma).min() > 0 and w.sum() <= 1 + 1e-9 and (w >= 0).all()
    lim = O.Limits(np.zeros(10), np.full(10, 0.25), O.group_limits(np.array(list("aabbbccccc")), 0.45))
    assert lim.feasible() and not O.Limits(np.zeros(3), np.full(3, 0.2)).feasible()
    mu = r.mean(0) * 52
    base = O.standard(r, r.mean(1), mu, sigma * 52, np.ones(10), lim)
    for name, x in base.items():
        assert abs(x.sum() - 1) < 1e-5 and x.min() >= -1e-6 and x.max() <= 0.25 + 1e-6, name
        assert all(x[g].sum() <= c + 1e-4 for g, c in lim.groups), name
    var = lambda x: x @ sigma @ x
    for _ in range(50):
        y = lim.project(RNG.dirichlet(np.ones(10)))
        assert var(base["gmv"]) <= var(y) + 1e-7
        assert O.sharpe(mu, sigma * 52)(base["msr"])[0] >= O.sharpe(mu, sigma * 52)(y)[0] - 1e-3
    terms = O.terms_for(r, r.mean(1), mu, sigma * 52, np.ones(10), base)
    assert set(t for b in O.BLENDS.values() for _, t in b) <= set(terms)


@pytest.mark.parametrize("name", ["sharpe", "sortino", "ir", "diversification", "score_cvar", "upm_lpm", "capture", "entropy", "concentration", "near_msr", "huber_bl"])
def test_gradients(name):
    rng = np.random.default_rng(3)
    r = rng.normal(0.001, 0.02, (120, 5))
    mu, sigma = r.mean(0) * 52, np.cov(r.T) * 52
    lim = O.Limits(np.zeros(5), np.ones(5))
    f = O.terms_for(r, r.mean(1) + rng.normal(0, 0.01, 120), mu, sigma, np.ones(5), O.standard(r, r.mean(1), mu, sigma, np.ones(5), lim))[name]
    w = np.array([0.1, 0.3, 0.2, 0.25, 0.15])
    v, g = f(w)
    h = 1e-6
    num = [(f(w + h * e)[0] - f(w - h * e)[0]) / (2 * h) for e in np.eye(5)]
    np.testing.assert_allclose(g, num, rtol=2e-3, atol=2e-3 * max(1, np.abs(num).max()))


def test_black_litterman_without_views_moves_nothing():
    s = np.array([[0.04, 0.01], [0.01, 0.09]])
    w = np.array([0.6, 0.4])
    pi = E.implied_returns(2.5, s, w)
    mu, _ = E.black_litterman(w, s, np.eye(2), pi)
    np.testing.assert_allclose(mu, pi)
    mu, post = E.black_litterman(w, s, np.array([[1.0, 0.0]]), np.array([pi[0] + 0.05]))
    assert pi[0] < mu[0] < pi[0] + 0.05 and np.linalg.eigvalsh(post).min() > 0


def test_estimators_recover_parameters():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.02, 400)
    y = 0.001 + 1.3 * x + rng.normal(0, 0.005, 400)
    for f in (E.ols_beta, E.dimson_beta):
        assert abs(f(y, x)[0] - 1.3) < 0.1
    assert abs(E.kalman_beta(y, x)[0] - 1.3) < 0.25
    z = rng.normal(size=(300, 3))
    b = E.huber_enet(z, 2 + z @ np.array([1.0, -2.0, 0.0]) + rng.normal(0, 0.1, 300), 0.0, 0.5, 1.5)
    np.testing.assert_allclose(b, [2, 1, -2, 0], atol=0.1)
    assert (E.huber_enet(z, z @ np.array([1.0, -2.0, 0.0]), 0.01, 0.5, 1.5, nonneg=True)[1:] >= 0).all()
    a = np.array([[0.5, 0.1], [0.0, 0.3]])
    s = E.simulate_var(np.zeros(2), a, np.zeros((1, 2)), rng.normal(0, 1, (1, 2000, 2)))[0]
    _, coef, _ = E.fit_bvar(s, 1, overall=10.0, own=0.0)
    np.testing.assert_allclose(coef, a, atol=0.08)
    assert E.companion_radius(np.array([[1.2, 0.0], [0.0, 0.5]]), 2) > 1 >= E.companion_radius(E.stable(np.array([[1.2, 0.0], [0.0, 0.5]]), 2), 2)
    for n in (10, 100):
        i = E.block_indices(50, n, 7, rng)
        assert len(i) == n and i.min() >= 0 and i.max() < 50
    p = E.simplex_box(rng.normal(size=20), np.zeros(20), np.full(20, 0.1))
    assert abs(p.sum() - 1) < 1e-9 and p.max() <= 0.1 + 1e-12
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    fixed = E.psd(bad)
    assert np.linalg.eigvalsh(fixed).min() > -1e-8 and np.allclose(np.diag(fixed), 1)
    for c, rho in (E.ledoit_wolf(z), E.oas(z)):
        assert 0 <= rho <= 1 and np.linalg.eigvalsh(c).min() > 0


def test_forecast_kernels():
    rng = np.random.default_rng(9)
    t = np.arange(160)
    fit, fc, sd = X.trend_season(0.02 * t + np.sin(2 * np.pi * t / 52), 26)
    want = 0.02 * np.arange(160, 186) + np.sin(2 * np.pi * np.arange(160, 186) / 52)
    assert np.abs(fc - want).max() < 0.35 and sd < 0.1
    e = rng.normal(size=600)
    y = np.zeros(600)
    for i in range(1, 600):
        y[i] = 0.7 * y[i - 1] + e[i]
    assert abs(X.arma(y, 1, 0)[0][1] - 0.7) < 0.08 and X.adf_order(y) == 0 and X.adf_order(np.cumsum(e)) == 1
    _, w = X.arma_ensemble(y, 5)
    assert abs(sum(w) - 1) < 1e-9
    s2, r = 1e-4, np.empty(1500)
    for i in range(1500):
        r[i] = math.sqrt(s2) * rng.normal()
        s2 = 4e-6 + 0.1 * r[i] ** 2 + 0.86 * s2
    _, a, b, _ = X.garch(r)
    assert 0.02 < a < 0.25 and 0.6 < b < 0.97
    h = X.two_regimes(np.r_[rng.normal(0, 0.01, 300), rng.normal(0, 0.05, 300)])
    assert h["sigma"][0] < 0.02 < 0.035 < h["sigma"][1] and h["last"][1] > 0.5
    assert X.isotonic(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == [1.0, 2.5, 2.5, 4.0]
    x = rng.normal(size=(500, 1))
    q = X.quantile_regression(x, 2 * x[:, 0] + rng.normal(size=500), 0.9)
    assert abs(q[1] - 2) < 0.3 and abs(q[0] - 1.28) < 0.3
    assert X.pinball(np.array([1.0]), np.array([0.0]), 0.9) == 0.9
    lab, _ = X.kmeans(np.r_[rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))], 2, rng)
    assert len(set(lab[:20])) == len(set(lab[20:])) == 1 and lab[0] != lab[-1]
    z = X.edgeworth(rng.normal(size=20000), -0.5, 4.0)
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9 and (z**3).mean() < -0.3
    tn = X.truncated_normal(0.5, 1.0, 0.0, 1.0, 1000, rng)
    assert len(tn) == 1000 and tn.min() >= 0 and tn.max() <= 1
    assert abs(X.pert(0, 1, 4, 20000, rng).mean() - (0 + 4 * 1 + 4) / 6) < 0.05
    m = X.boosted(x, np.where(x[:, 0] > 0, 1.0, -1.0))
    assert np.corrcoef(X.boosted_predict(m, x), np.where(x[:, 0] > 0, 1, -1))[0, 1] > 0.95
    a = np.arange(12) * np.pi / 12
    f = rng.normal(size=(200, 2)) @ np.array([np.cos(a), np.sin(a)]) + 0.1 * rng.normal(size=(200, 12))
    assert X.n_components(f, 6) == 2
    a, b, c = X.dcc(rng.normal(size=(200, 3)))
    assert np.allclose(np.diag(c), 1) and np.linalg.eigvalsh(c).min() > 0
    assert X.gpd_tail(rng.standard_t(4, 2000))[1] > -0.2


def test_simulations_do_not_depend_on_partitions(spark):
    p = panel(spark, {s: (100 * np.exp(np.cumsum(RNG.normal(0, 0.02, 90)))).tolist() for s in (1, 2, 3)})
    a = X.return_paths(p.repartition(1), 8, 50).orderBy("symbol").collect()
    b = X.return_paths(p.repartition(7), 8, 50).orderBy("symbol").collect()
    assert a == b and all(r["p05"] <= r["p50"] <= r["p95"] for r in a)


def test_text(spark):
    df = spark.createDataFrame([(1, "BUY GME now! GME to the moon, sell AMC"), (2, "THE end"), (3, None)], "doc_id long, text string")
    got = {r["ticker"]: r for r in TX.mentions(df).collect()}
    assert set(got) == {"BUY", "GME", "AMC", "THE"} - {"THE"} and got["GME"]["mentions"] == 2
    assert got["GME"]["top_words"].split(", ")[0] == "gme" and got["GME"]["sentiment_std"] == 0.0
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent_id string")
    assert {r["id"]: r["depth"] for r in TX.comment_depths(tree, 3).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    html = spark.createDataFrame([("<p><table><tr><th>A</th><td> <b>1</b></td></tr><tr><td>B</td><td>2</td></tr></table>",)], "html string")
    assert [r["cells"] for r in TX.html_table(html).collect()] == [["A", "1"], ["B", "2"]]
    raw = spark.createDataFrame([('{"data":{"children":[{"kind":"t3","data":{"id":"x","title":"t","selftext":"s","score":3}},{"kind":"t1","data":{"id":"y"}}]}}',)], "json string")
    assert [tuple(r) for r in TX.listing(raw).collect()] == [("x", "t", "s", 3)]

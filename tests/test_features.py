"""Model inputs: kernels against plain versions, and the cases the oracles' tables don't hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import features as M
from quantloom.operators import forecast as X


def test_excitation_is_the_best_of_a_plain_search():
    rng = np.random.default_rng(3)
    y, h = np.zeros(600), 0.0
    for t in range(600):
        y[t] = rng.random() < 1 / (1 + math.exp(-(-3 + 6 * h)))
        h = math.exp(-2) * (h + y[t])
    past = np.zeros(600)
    for t in range(1, 600):
        past[t] = math.exp(-2) * past[t - 1] + y[t - 1]
    cost = lambda mu, a: float((np.logaddexp(0, mu + a * past) - y * (mu + a * past)).sum())
    mu, slope, found = M._logit(past, y)
    assert found == pytest.approx(cost(mu, slope))
    assert found <= min(cost(m, a) for m in np.linspace(-5, 0, 51) for a in np.linspace(0, 9, 46)) + 1e-9
    strength, decay = M.jump_excitation(y)
    assert 0 < strength <= 1 and decay in M.DECAYS


def test_excitation_without_jumps_or_values():
    assert M.jump_excitation(np.zeros(100)) == (0.0, 2.0)
    assert M.jump_excitation(np.ones(5)) == (0.0, 2.0)
    regular = np.tile([1.0] + [0.0] * 9, 30)
    assert M.jump_excitation(regular)[0] == 0.0


@pytest.mark.parametrize(("p", "dof", "want"), [(0.975, 5, 2.570582), (0.95, 10, 1.812461), (0.05, 10, -1.812461), (0.975, None, 1.959964)])
def test_t_quantile(p, dof, want):
    assert M.t_quantile(p, dof) == pytest.approx(want, abs=1e-5)


def test_growth_draws():
    rng = np.random.default_rng(1)
    g = M.growth_draws(None, None, rng, 50000)
    assert g.mean() == pytest.approx((0 + 6 * 0.02 + 0.04) / 8, abs=2e-4)
    flat = M.growth_draws(np.full(30, 0.15), np.zeros(20000), rng, 20000)
    assert flat.mean() == pytest.approx(0.15, abs=1e-3) and flat.std() == pytest.approx(0.02, rel=0.05)
    none = M.growth_draws(np.empty(0), np.full(20000, 0.5), rng, 20000)
    assert none.mean() == pytest.approx(0.05, abs=1e-3)
    assert (np.abs(M.growth_draws(np.array([50.0]), np.full(100, -3.0), rng, 100)) <= 1).all()


def test_nulls_gaps_and_short_series(spark):
    rows = [("A", d, v) for d, v in ((1, 1.0), (2, None), (3, 4.0), (4, -1.0))] + [("B", 1, None), ("C", 1, 2.0), ("C", 2, 2.0), ("C", 3, 2.0), ("C", 4, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, date int, ret double")
    steps = {(r.symbol, r.date): r.ret for r in M.deltas(df, {"ret": "diff"}).collect()}
    assert steps == {("A", 2): None, ("A", 3): None, ("A", 4): -5.0, ("C", 2): 0.0, ("C", 3): 0.0, ("C", 4): 0.0}
    logs = {(r.symbol, r.date): r.ret for r in M.deltas(df, {"ret": "dlog"}).collect()}
    assert logs[("A", 4)] == pytest.approx(math.log(1e-6 / 4))
    fits = {r.symbol: r for r in M.ar1_baselines(df, horizon=3).collect()}
    assert set(fits) == {"A", "C"}
    assert (fits["C"].phi, fits["C"].mean, fits["C"].expected_sum) == (0.0, 2.0, 6.0)
    assert fits["A"].phi == pytest.approx(-5 / 3) and fits["A"].n == 3
    kinds = {r.symbol: (r.n, r.is_returns) for r in M.looks_like_returns(df, "ret").collect()}
    assert kinds == {"A": (3, False), "B": (0, True), "C": (4, False)}
    scales = {r.symbol: r for r in M.robust_scales(df, ["ret"]).collect()}
    assert scales["C"].ret_scale == 1.0 and scales["B"].ret_median is None
    scaled = {(r.symbol, r.date): r.ret for r in M.robustly_scaled(df, M.robust_scales(df, ["ret"]), ["ret"]).collect()}
    assert scaled[("A", 2)] is None and scaled[("C", 1)] == 0.0 and len(scaled) == 9
    design = M.lagged_design(df.filter("symbol = 'C'"), ["ret"], lags=(0, 2)).collect()
    assert [r.date for r in design] == [3, 4] and "ret_L0" in design[0].asDict()


def test_states_of_one_row_and_none(spark):
    df = spark.createDataFrame([("A", 1, 0.5), ("B", 1, None)], "symbol string, date int, ret double")
    (one,) = M.jump_states(M.jump_flags(df)).collect()
    assert (one.symbol, one.p00, one.p11, one.emit0, one.emit1, one.n_tail) == ("A", 0.0, 0.0, 0.5, 0.01, 1)
    assert M.jump_intensity(M.jump_flags(df)).count() == 1
    assert M.jump_states(M.jump_flags(df.limit(0))).count() == 0


def test_spread_scale_finds_the_planted_one(spark):
    rng = np.random.default_rng(5)
    rows = [("A", float(x) * 1.2, 0.0, 1.0) for x in rng.standard_normal(8000)] + [("A", None, 0.0, 1.0)]
    (r,) = M.spread_scales(spark.createDataFrame(rows, "symbol string, y double, mu double, sigma double"), "y", "mu", "sigma").collect()
    assert r.n == 8000 and r.scale == pytest.approx(1.2, abs=0.05)


def test_growth_of_strings_and_missing_payouts(spark):
    h = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.1), ("B", 1, None), ("C", 1, 0.2)], "symbol string, date int, roe double")
    p = spark.createDataFrame([("A", 0.5, 0.0), ("B", 0.5, None)], "symbol string, payout double, payout_sd double")
    got = {r.symbol: r for r in M.terminal_growth(h, p, 4000).collect()}
    assert got["A"].mean == pytest.approx(0.05, abs=2e-3) and got["B"].n == 0
    assert got["C"].mean == pytest.approx(0.02, abs=1e-3)
    assert got == {r.symbol: r for r in M.terminal_growth(h.repartition(3), p, 4000).collect()}


class NoPowers(np.ndarray):
    """Draws that refuse np.power, which takes most of a simulation's time."""

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kw):
        assert ufunc is not np.power
        plain = lambda xs: tuple(x.view(np.ndarray) if isinstance(x, np.ndarray) else x for x in xs)
        got = getattr(ufunc, method)(*plain(inputs), **({"out": plain(out)} if out else {}), **kw)
        return got.view(NoPowers) if isinstance(got, np.ndarray) else got


def test_edgeworth_shocks_are_the_polynomial_without_powers():
    rng = np.random.default_rng(3)
    for skew, kurt in ((-0.5, 4.0), (0.0, 3.0), (1.2, 9.0)):
        z = rng.standard_normal(5000)
        e = z + skew / 6 * (z * z - 1) + (kurt - 3) / 24 * (z**3 - 3 * z) - skew**2 / 36 * (2 * z**3 - 5 * z)
        got = X.edgeworth(z.view(NoPowers), skew, kurt).view(np.ndarray)
        np.testing.assert_allclose(got, (e - e.mean()) / e.std(), atol=1e-12)
    assert np.isnan(X.edgeworth(rng.standard_normal(10), np.nan, 3.0)).all()


def test_simulations_stay_dealt_over_tasks(spark):
    params = spark.createDataFrame([(s, 0.05, 0.2, 0.0, 3.0, 100.0) for s in range(40)], "symbol long, mu double, sigma double, skew double, kurt double, price double")
    got = X.gbm_terminal(spark, params, 100, 2).select(F.spark_partition_id().alias("p")).distinct().count()
    assert got == int(spark.conf.get("spark.sql.shuffle.partitions"))

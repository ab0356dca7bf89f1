"""Whole grids: sets are searched without a step a bar, and give what positions held bar by bar give."""

import time

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import calibration as K


def stepwise(buy, sell, ret):
    """Bar by bar over dense masks, as plainly as can be."""
    shape = np.broadcast_shapes(buy.shape[1:], sell.shape[1:])
    now, got = np.zeros(shape), []
    for b, s, r in zip(buy[:-1], sell[:-1], ret[1:], strict=True):
        now = np.where(s, -1.0, np.where(b, 1.0, now))
        got.append(now * r)
    got = np.array(got)
    sd = got.std(axis=0, ddof=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sd > 1e-9, np.sqrt(252) * got.mean(axis=0) / sd, np.nan)


def walk(n=533, seed=3):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    return pd.DataFrame({"high": close * (1 + rng.random(n) / 200), "low": close * (1 - rng.random(n) / 200), "close": close, "volume": rng.integers(1, 90, n)})


@pytest.mark.parametrize("share", [(0.1, 0.1), (0.5, 0.02), (0.3, 0.0), (0.0, 0.3), (0.0, 0.0)])
def test_sweeps_hold_the_last_pulse(share):
    rng = np.random.default_rng(5)
    ret = np.append(np.nan, rng.normal(0, 0.02, 79))
    buy, sell = rng.random((80, 7)) < share[0], rng.random((80, 9)) < share[1]
    want = stepwise(buy[:, :, None], sell[:, None, :], ret)
    for got in (K.sweep(buy[:, :, None], sell[:, None, :], ret), K.sweep_pairs(buy, sell, ret)):
        np.testing.assert_allclose(got, want, rtol=1e-9)
    rows = np.flatnonzero(buy.any(axis=1) | sell.any(axis=1))
    np.testing.assert_allclose(K.sweep(buy[rows][:, :, None], sell[rows][:, None, :], ret, rows), want, rtol=1e-9)
    assert np.isnan(K.sweep_pairs(buy[:2], sell[:2], ret[:2])).all() and np.isnan(K.sweep(buy[:2, :, None], sell[:2, None, :], ret[:2])).all()


@pytest.mark.parametrize("name", list(K.GRIDS))
def test_full_grids_hold_each_set_of_small_ones(name):
    bars, rng = K.Bars(walk(150)), np.random.default_rng(8)
    full = {p: list(v) for p, v in K.GRIDS[name].items()}
    got = getattr(bars, name)(full)
    assert got.shape == tuple(len(v) for v in full.values()) and np.isfinite(got).any()
    for _ in range(20):
        at = tuple(int(rng.integers(len(v))) for v in full.values())
        one = getattr(bars, name)({p: [v[i]] for (p, v), i in zip(full.items(), at, strict=True)})
        assert one.ravel()[0] == pytest.approx(got[at], rel=1e-9, nan_ok=True), at


def test_stochastic_and_breakout_sets_bar_by_bar():
    x = walk(200)
    bars, c = K.Bars(x), x["close"]
    k = (100 * (c - x["low"].rolling(14).min()) / (x["high"].rolling(14).max() - x["low"].rolling(14).min())).to_numpy()
    up, down = K.crossings(k, pd.Series(k).rolling(3).mean().to_numpy())
    low, high = K.GRIDS["stoch"]["low"], K.GRIDS["stoch"]["high"]
    np.testing.assert_allclose(bars.stoch(K.GRIDS["stoch"]), stepwise((up[:, None] & (k[:, None] < low))[:, :, None], (down[:, None] & (k[:, None] > high))[:, None, :], bars.ret), rtol=1e-7)
    mult, a = K.GRIDS["atr"]["mult"], pd.Series(bars.true_range).rolling(9).mean().shift().to_numpy()
    top, bottom = x["high"].rolling(12).max().shift().to_numpy(), x["low"].rolling(12).min().shift().to_numpy()
    want = stepwise(c.to_numpy()[:, None] > top[:, None] + a[:, None] * mult, c.to_numpy()[:, None] < bottom[:, None] - a[:, None] * mult, bars.ret)
    np.testing.assert_allclose(bars.atr(K.GRIDS["atr"])[9 - 5, (12 - 10) // 2], want, rtol=1e-7)


def test_full_grid_costs_less_than_bars_times_sets():
    """A step a bar over all sets, without their returns, takes longer than the search of the whole grid."""
    bars = K.Bars(walk())
    buy, sell, grid = np.zeros((533, 96, 1), bool), np.zeros((533, 1, 98), bool), K.GRIDS["stoch"]
    bars.stoch(grid)

    def took(f):
        return min(-time.process_time() + (f(), time.process_time())[1] for _ in range(3))

    def plain():
        now = np.zeros((96, 98))
        for b, s in zip(buy, sell, strict=True):
            now = np.where(s, -1.0, np.where(b, 1.0, now))

    assert took(lambda: bars.stoch(grid)) < took(plain)


def test_histories_come_in_order_and_whole(spark):
    from quantloom.functions import grouped as G

    rows = [(s, f"2020-01-{d + 1:02d}", None if d == 3 else float(10 * i + d)) for i, s in enumerate(("b", "a", None)) for d in range(9)]
    df = spark.createDataFrame(rows[::-1], "symbol string, date string, x double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # groups span batches
    try:
        got = G.per_history(df, "symbol", "date", "symbol {key}, xs array<double>", lambda k, x: [(k, x["x"].tolist())]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3
    for k, xs in got:
        at = ("b", "a", None).index(k)
        np.testing.assert_array_equal(xs, [np.nan if d == 3 else 10.0 * at + d for d in range(9)])

"""Calibration of trading rules over full parameter grids, one kernel call a symbol.

A symbol's bars are shuffled once; its backtests run over whole grids at once as numpy arrays, over the bars that have pulses, so a grid
costs memory for some of its sets at those bars and never copies the panel. Each rule's positions hold the last pulse (sells win); the return of
a bar belongs to the position before it. Of the sets with the best Sharpe ratio (to nine digits) the first in order is taken:
with one count of returns for all sets of a symbol, the best Sharpe is the most significant too.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import grouped as G
from quantloom.functions import special as S
from quantloom.operators import indicators as I

#: The full grids of each rule.
GRIDS = {
    "rsi": {"window": range(5, 31), "low": np.arange(1, 49, 0.5), "high": np.arange(51, 100, 0.5)},
    "mfi": {"window": range(5, 31), "low": np.arange(1, 49, 0.5), "high": np.arange(51, 100, 0.5)},
    "bb": {"window": range(5, 31), "width": np.arange(0.75, 3, 0.05)},
    "atr": {"window": range(5, 31), "break": range(10, 51, 2), "mult": np.arange(0.75, 3, 0.05)},
    "stoch": {"low": np.arange(1, 49, 0.5), "high": np.arange(51, 100, 0.5)},
    "ema": {"fast": range(5, 21), "slow": range(20, 61, 2)},
    "macd": {"fast": range(7, 16), "slow": range(20, 34), "signal": range(6, 12)},
    "vwap": {"window": range(5, 40)},
    "obv": {"lookback": range(5, 40)},
}
#: The coarse grids of a first screening; windows that are not named stay as in the full grids.
COARSE = {
    "rsi": {"low": [25, 30, 35], "high": [65, 75, 85]},
    "mfi": {"low": [20, 25, 30], "high": [75, 80, 85]},
    "bb": {"width": [1.5, 2.0, 2.5]},
    "atr": {"mult": [1.25, 1.5, 2.0, 2.5]},
    "stoch": {"low": [15, 20, 25], "high": [75, 80, 85]},
    "ema": {"fast": [8, 12, 16], "slow": [20, 26, 34]},
    "macd": {"fast": [8, 12, 16], "slow": [20, 26, 34], "signal": [6, 9, 12]},
    "vwap": {"window": [10, 20, 30]},
    "obv": {"lookback": [15, 20, 30]},
}


#: Sets, and bars x sets, that are searched at once.
SETS, CELLS = 1024, 1 << 18


def rolled(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over the last n values; NaN before there are n."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = f(sliding_window_view(x, n), axis=1)
    return out


def rolled_each(x: np.ndarray, windows, f: np.ufunc) -> np.ndarray:
    """f accumulated over the last n values, one column for each n; NaN before there are n. Each length goes on from the one before."""
    windows = [int(n) for n in windows]
    out, last = np.full((len(x), len(windows)), np.nan), x
    for n in range(1, min(max(windows), len(x)) + 1):
        last = f(last[1:], x[: len(x) - n + 1]) if n > 1 else x
        for i in (i for i, w in enumerate(windows) if w == n):
            out[n - 1 :, i] = last
    return out


def deviations(x: np.ndarray, windows, mean: np.ndarray) -> np.ndarray:
    """Population deviations over the last n values about their means, one column for each n."""
    windows, mean = np.asarray(windows, int), np.ascontiguousarray(mean.T)
    square = np.zeros(mean.shape)
    for k in range(min(windows.max(), len(x))):
        within = np.flatnonzero(windows > k)
        # The windows with this lag are most often the last ones, which are no copy.
        at = slice(within[0], None) if len(within) == len(windows) - within[0] else within
        off = x[: len(x) - k] - mean[at, k:]
        square[at, k:] += off * off
    return np.ascontiguousarray(np.sqrt(square / windows[:, None]).T)


def before(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate([np.full((min(k, len(x)), *x.shape[1:]), np.nan), x[: max(len(x) - k, 0)]])


def ewm_columns(x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Exponential means without gaps (adjust=False) of x, one column for each alpha; x has one column or as many."""
    out = (x if x.ndim == 2 else x[:, None]) * alpha
    if len(x):
        out[0] = x[0]
    rest, carried = 1 - alpha, np.empty(out.shape[1])
    rows = list(out)
    for last, now in zip(rows, rows[1:], strict=False):
        np.multiply(rest, last, carried)
        np.add(carried, now, now)
    return out


class Gains:
    """Returns summed up to each bar, their squares after it, and with them the Sharpe ratios of many sets."""

    def __init__(self, ret: np.ndarray):
        self.n = len(ret) - 1
        self.upto = np.concatenate([[0.0], np.cumsum(ret[1:])])
        self.squares = np.concatenate([np.cumsum((ret[1:] ** 2)[::-1])[::-1], [0.0]])

    def sharpe(self, first: np.ndarray, long: np.ndarray) -> np.ndarray:
        """first: the bar of a set's first pulse, the last bar where it has none. long: the returns while it is long; what it is not
        long since its first pulse, it is short."""
        mean = (2 * long - (self.upto[-1] - self.upto[first])) / self.n
        var = (self.squares[first] - self.n * mean * mean) / (self.n - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(var > 1e-18, np.sqrt(252.0) * mean / np.sqrt(np.maximum(var, 0)), np.nan)


def sweep(buy: np.ndarray, sell: np.ndarray, ret: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Sharpe ratio of every parameter set. buy and sell: (bars, ...) masks that broadcast to one shape of sets, of all bars or of
    those in ``at``.

    Only bars with a pulse count. A set is long where its last buy is later than its last sell, which are found before the masks
    meet, so that a bar and set costs one comparison and one sum.
    """
    shape = np.broadcast_shapes(buy.shape[1:], sell.shape[1:])
    buys, sells = (m.any(axis=tuple(range(1, m.ndim))) for m in (buy, sell))
    used = np.flatnonzero(buys | sells)
    if len(ret) < 3 or not len(used):
        return np.full(shape, np.nan)
    gains, bars = Gains(ret), used if at is None else at[used]
    starts = np.append(bars, len(ret) - 1)
    if not (buys.any() and sells.any()):  # a set keeps its first position
        pulses = (buy if buys.any() else sell)[used]
        # The largest of numbers that fall is the first: quicker than argmax along the first axis.
        fall = np.arange(len(used), 0, -1, dtype=np.int16 if len(used) < 32000 else np.int32).reshape(-1, *[1] * (pulses.ndim - 1))
        first = starts[len(used) - np.max(pulses * fall, axis=0)]
        return np.broadcast_to(gains.sharpe(first, (gains.upto[-1] - gains.upto[first]) if buys.any() else np.zeros(first.shape)), shape)
    step = np.diff(gains.upto[bars], append=gains.upto[-1])
    order = np.arange(2, 2 * len(used) + 2, 2, dtype=np.int16 if len(used) < 16000 else np.int32)  # sells get odd numbers: they win
    bought, sold = (np.maximum.accumulate(np.where(m[used], o.reshape(-1, *[1] * (m.ndim - 1)), o.dtype.type(0)), axis=0) for m, o in ((buy, order), (sell, order + order.dtype.type(1))))
    first = starts[np.minimum(*(np.count_nonzero(m == 0, axis=0) for m in (bought, sold)))]
    long = np.empty(shape)
    some = max(1, CELLS // (len(used) * max(1, int(np.prod(shape[1:])))))
    for i in range(0, shape[0], some):
        b, s = (m if m.shape[1] == 1 else m[:, i : i + some] for m in (bought, sold))
        long[i : i + some] = np.einsum("e,e...->...", step, b > s)
    return gains.sharpe(first, long)


def sweep_pairs(buy: np.ndarray, sell: np.ndarray, ret: np.ndarray) -> np.ndarray:
    """Sharpe ratio of every pair of a column of buy and one of sell (bars x columns).

    A buy is held up to the pair's next sell, and counts where there was a sell since the buy before: a pair costs its buys, not
    its bars.
    """
    last = len(ret) - 1
    if last < 2:
        return np.full((buy.shape[1], sell.shape[1]), np.nan)
    gains, t = Gains(ret), np.arange(len(ret), dtype=np.int32)[:, None]
    sold = np.maximum.accumulate(np.where(sell, t, t.dtype.type(-1)), axis=0)
    until = np.minimum.accumulate(np.where(sell, t, t.dtype.type(last))[::-1], axis=0)[::-1]
    column, bar = np.nonzero(buy.T)
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    bought = np.full(buy.shape[1], last)
    bought[column[starts]] = bar[starts]
    first = np.minimum(bought[:, None], until[0])
    earlier = np.append(-1, bar)[: len(bar)]
    earlier[starts] = -1
    long = np.zeros(first.shape)
    if len(bar):
        long[column[starts]] = np.add.reduceat((gains.upto[until[bar]] - gains.upto[bar][:, None]) * (sold[bar] >= earlier[:, None]), starts, axis=0)
    return gains.sharpe(first, long)


def over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x crosses over y (columns may differ in number)."""
    with np.errstate(invalid="ignore"):
        now, was = x > y, x <= y
    out = np.zeros(now.shape, bool)
    np.logical_and(now[1:], was[:-1], out=out[1:])
    return out


def crossings(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x crosses over y, x crosses under y (columns may differ in number)."""
    return over(x, y), over(y, x)


def alike(values: np.ndarray, limits: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Limits that no value lies between give one mask: the first of each such group, and the group of every limit."""
    return np.unique(np.searchsorted(np.sort(values), limits, side), return_index=True, return_inverse=True)[1:]


class Bars:
    """One symbol's bars as arrays, and the parts of the indicators that all parameter sets share. A rule gives the Sharpe ratios
    of its grid, one axis for each parameter in order."""

    def __init__(self, x: pd.DataFrame | dict[str, np.ndarray]):
        self.high, self.low, self.close, self.volume = (np.asarray(x[c], float) for c in ("high", "low", "close", "volume"))
        self.ret = np.append(np.nan, self.close[1:] / self.close[:-1] - 1)
        prev = before(self.close)
        self.true_range = np.fmax(self.high - self.low, np.fmax(np.abs(self.high - prev), np.abs(self.low - prev)))
        self.typical = (self.high + self.low + self.close) / 3

    def levels(self, values: np.ndarray, g: dict) -> np.ndarray:
        """values: one column for each window."""
        low, high = np.asarray(g["low"], float), np.asarray(g["high"], float)
        out = np.empty((values.shape[1], len(low), len(high)))
        some = max(1, SETS // (len(low) * len(high)))
        for i in range(0, values.shape[1], some):
            v = values[:, i : i + some]
            if some > 1:
                v = v[:, None, :]  # windows are the last axis: numpy's inner loops are long then
                out[i : i + some] = sweep(over(v, low[:, None])[:, :, None], over(high[:, None], v)[:, None], self.ret).transpose(2, 0, 1)
                continue
            known = v[~np.isnan(v)]
            (lows, to_low), (highs, to_high) = alike(known, low, "right"), alike(known, high, "left")
            out[i] = sweep_pairs(over(v, low[lows]), over(high[highs], v), self.ret)[to_low[:, None], to_high]
        return out

    def rsi(self, g: dict) -> np.ndarray:
        step = np.diff(self.close, prepend=np.nan)
        alpha = 1 / np.asarray(g["window"], float)
        both = np.repeat(np.stack([np.where(s > 0, s, 0.0) for s in (step, -step)], axis=1), len(alpha), axis=1)
        up, down = np.split(ewm_columns(both, np.tile(alpha, 2)), 2, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
        for i, n in enumerate(g["window"]):
            value[: n - 1, i] = np.nan
        return self.levels(value, g)

    def mfi(self, g: dict) -> np.ndarray:
        step, flow = np.diff(self.typical, prepend=np.nan), self.typical * self.volume
        with np.errstate(divide="ignore", invalid="ignore"):
            up, down = (rolled_each(np.where(s > 0, flow, 0.0), g["window"], np.add) for s in (step, -step))
            return self.levels(np.where(down == 0, np.nan, 100 - 100 / (1 + up / down)), g)

    def bb(self, g: dict) -> np.ndarray:
        width, c = np.asarray(g["width"], float)[:, None], self.close[:, None, None]
        mid = rolled_each(self.close, g["window"], np.add) / np.asarray(g["window"])
        mid, sd = mid[:, None], deviations(self.close, g["window"], mid)[:, None]
        some = max(1, SETS // len(width))
        return np.concatenate([sweep(over(c, m - width * s), over(m + width * s, c), self.ret).T for m, s in ((mid[:, :, i : i + some], sd[:, :, i : i + some]) for i in range(0, mid.shape[2], some))])

    def atr(self, g: dict) -> np.ndarray:
        mult, out = np.asarray(g["mult"], float), []
        mean = before(rolled_each(self.true_range, g["window"], np.add) / np.asarray(g["window"]))[:, None, None]
        tops, bottoms = (before(rolled_each(x, g["break"], f)) for x, f in ((self.high, np.maximum), (self.low, np.minimum)))
        least = np.fmin(np.fmin.reduce(mean * np.array([[mult.min()], [mult.max()]]), axis=(1, 2, 3)), 0.0)[:, None]
        shape, some = (len(mult), mean.shape[3]), max(1, SETS // (mean.shape[3] * len(mult)))
        for i in range(0, tops.shape[1], some):
            top, bottom, c = tops[:, i : i + some], bottoms[:, i : i + some], self.close[:, None]
            with np.errstate(invalid="ignore"):
                # Bars without a pulse under the smallest step have none under the others.
                up, down = ((m.any(axis=1)) for m in (c > top + least, c < bottom - least))
                t = np.flatnonzero(up | down)
                step, c, no = mean[t] * mult[:, None], c[t, :, None, None], np.zeros((len(t), 1, 1, 1), bool)
                sell = c < bottom[t, :, None, None] - step if down.any() else no
                buy = c > np.add(top[t, :, None, None], step, out=step if top.shape[1] == 1 else None) if up.any() else no
            out.append(np.broadcast_to(sweep(buy, sell, self.ret, t), (top.shape[1], *shape)))
        return np.concatenate(out).transpose(2, 0, 1)  # window, break, mult

    def stoch(self, g: dict) -> np.ndarray:
        low, high = np.asarray(g["low"], float), np.asarray(g["high"], float)
        bottom, top = (rolled_each(x, [I.STOCH_K], f)[:, 0] for x, f in ((self.low, np.minimum), (self.high, np.maximum)))
        with np.errstate(divide="ignore", invalid="ignore"):
            k = np.where(top == bottom, np.nan, 100 * (self.close - bottom) / (top - bottom))
            up, down = crossings(k, rolled(k, I.STOCH_D, np.mean))
            (lows, to_low), (highs, to_high) = alike(k[up], low, "left"), alike(k[down], high, "right")
            buy, sell = up[:, None] & (k[:, None] < low[lows]), down[:, None] & (k[:, None] > high[highs])
        return sweep_pairs(buy, sell, self.ret)[to_low[:, None], to_high]

    def ema(self, g: dict) -> np.ndarray:
        fast, slow = np.asarray(g["fast"], float), np.asarray(g["slow"], float)
        mean = ewm_columns(self.close, 2 / (np.append(fast, slow) + 1))
        f, s = mean[:, : len(fast), None], mean[:, None, len(fast) :]
        return np.where(slow > fast[:, None], sweep(over(f, s), over(s, f), self.ret), np.nan)

    def macd(self, g: dict) -> np.ndarray:
        fast, slow, smooth = (np.asarray(g[p], float) for p in ("fast", "slow", "signal"))
        mean = ewm_columns(self.close, 2 / (np.append(fast, slow) + 1))
        line = np.repeat((mean[:, : len(fast), None] - mean[:, None, len(fast) :]).reshape(len(mean), -1), len(smooth), axis=1)
        signal = ewm_columns(line, np.tile(2 / (smooth + 1), len(fast) * len(slow)))
        got = sweep(over(line, signal), over(signal, line), self.ret).reshape(len(fast), len(slow), len(smooth))
        return np.where((slow > fast[:, None])[:, :, None], got, np.nan)

    def vwap(self, g: dict) -> np.ndarray:
        total, c = rolled_each(self.volume, g["window"], np.add), self.close[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(total == 0, np.nan, rolled_each(self.typical * self.volume, g["window"], np.add) / total)
        return sweep(over(c, value), over(value, c), self.ret)

    def obv(self, g: dict) -> np.ndarray:
        balance = np.cumsum(np.nan_to_num(np.sign(np.diff(self.close, prepend=np.nan))) * self.volume)
        ends = [before(rolled_each(x, g["lookback"], f)) for x, f in ((self.close, np.minimum), (balance, np.minimum), (self.close, np.maximum), (balance, np.maximum))]
        c, b = self.close[:, None], balance[:, None]
        with np.errstate(invalid="ignore"):
            return sweep((c < ends[0]) & (b >= ends[1]), (c > ends[2]) & (b <= ends[3]), self.ret)


def best_of(bars: Bars, name: str, grid: dict) -> tuple[dict[str, float], float | None]:
    """The best set of one rule's grid: its parameters and Sharpe ratio."""
    sharpe = getattr(bars, name)(grid)
    key = np.where(np.isnan(sharpe), -np.inf, np.round(sharpe, 9))
    at = np.unravel_index(int(np.argmax(key)), key.shape)
    return {p: float(grid[p][i]) for p, i in zip(grid, at, strict=True)}, None if key[at] == -np.inf else float(key[at])


def calibrate(bars: DataFrame, grids: dict = GRIDS, names: tuple[str, ...] = I.NAMES, alpha: float = 0.05, screen: dict | None = None, least: float = 0.0) -> DataFrame:
    """One row per symbol and rule: best parameters as JSON, statistics and weight.

    ``screen``: coarse grids that are tried first; a rule without a significant set in its coarse grid keeps that one's best,
    the others go on to the full grid. Symbols of any type; a symbol with fewer than three bars has no Sharpe ratio.
    """
    def run(symbol, x: dict[str, np.ndarray]) -> list[tuple]:
        one = Bars(x)
        n = max(len(one.close) - 1, 0)
        lr = np.log1p(one.ret[1:])
        held = float(np.sqrt(252) * lr.mean() / lr.std(ddof=1)) if n > 1 and lr.std(ddof=1) > 0 else None
        out = []
        for name in names:
            full = grids[name]
            params, sharpe = None, None
            for grid in ([{**full, **screen[name]}] if screen and name in screen else []) + [full]:
                if params is not None and (sharpe is None or sharpe < least or S.t_sf(max(sharpe * np.sqrt(n / 252), 0.0), max(n - 1, 1)) >= alpha):
                    break
                params, sharpe = best_of(one, name, grid)
            t = sharpe * np.sqrt(n / 252) if sharpe is not None else 0.0
            out.append((symbol, name, json.dumps(params), n, sharpe, held, float(t), S.t_sf(max(t, 0.0), max(n - 1, 1))))
        return out

    rows = G.per_history(bars.select("symbol", "date", "high", "low", "close", "volume"), "symbol", "date", "symbol {key}, indicator string, param_json string, n long, sharpe double, sharpe_bh double, t_stat double, p_value double", run)
    return rows.withColumn("weight", I.weight(alpha, least)).withColumn("significant", F.col("sharpe").isNotNull() & (F.col("p_value") < alpha))

"""Forecasting and Monte Carlo per symbol: trend and seasonality, ARMA-like fits, GARCH, regimes, tails, bootstraps, paths.

Each kernel sees one symbol's history. Random streams are seeded by (seed, symbol), so results don't depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantloom.functions import grouped as G
from quantloom.functions import panel as P
from quantloom.operators import estimators as E
from quantloom.operators import joins as J
from quantloom.operators import metrics as M
from quantloom.sources.tables import stored


def rng_for(seed: int, key) -> np.random.Generator:
    return G.seeded(seed, key)


def fourier_design(t: np.ndarray, period: float, k: int) -> np.ndarray:
    return np.column_stack([f(2 * math.pi * j * t / period) for j in range(1, k + 1) for f in (np.sin, np.cos)])


def trend_season(y: np.ndarray, horizon: int, period: float = 52, k: int = 3, knots: int = 6, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Piecewise-linear trend with ridge-damped changes and Fourier season: fitted, forecast, residual deviation."""
    n = len(y)
    t = np.arange(n + horizon)
    bends = np.linspace(0, 0.8 * n, knots + 1)[1:]
    x = np.column_stack([np.ones(n + horizon), t, *[np.maximum(t - b, 0) for b in bends], fourier_design(t, period, k)])
    pen = np.r_[0, 0, np.full(knots, ridge * n), np.full(2 * k, 0.1)]
    b = np.linalg.solve(x[:n].T @ x[:n] + np.diag(pen) + 1e-9 * np.eye(x.shape[1]), x[:n].T @ y)
    return x[:n] @ b, x[n:] @ b, float((y - x[:n] @ b).std(ddof=1))


def adf_order(x: np.ndarray) -> int:
    """1 if the Dickey-Fuller t (one lag, constant) is above the 5 % critical value -2.86, else 0."""
    d = np.diff(x)
    z = np.column_stack([np.ones(len(d) - 1), x[1:-1], d[:-1]])
    b, *_ = np.linalg.lstsq(z, d[1:], rcond=None)
    e = d[1:] - z @ b
    se = math.sqrt(max((e @ e) / max(len(e) - 3, 1) * np.linalg.pinv(z.T @ z)[1, 1], 1e-300))
    return int(b[1] / se > -2.86)


def arma(y: np.ndarray, p: int, q: int, exog: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Hannan-Rissanen: innovations from a long autoregression, then least squares. Coefficients, residuals, AICc."""
    n = len(y)
    long = min(max(p + q, 4), n // 3)
    x, z = E.lagged(y[:, None], long)
    e = np.r_[np.zeros(long), z[:, 0] - x @ np.linalg.lstsq(x, z[:, 0], rcond=None)[0]]
    m = max(p, q, long if q else 0)
    cols = [np.ones(n - m), *[y[m - k : n - k] for k in range(1, p + 1)], *[e[m - k : n - k] for k in range(1, q + 1)]]
    if exog is not None:
        cols += list(exog[m:].T)
    d = np.column_stack(cols)
    b, *_ = np.linalg.lstsq(d, y[m:], rcond=None)
    r = y[m:] - d @ b
    k = d.shape[1] + 1
    aicc = len(r) * math.log(max(r.var(), 1e-300)) + 2 * k + 2 * k * (k + 1) / max(len(r) - k - 1, 1)
    return b, r, aicc


def arma_path(y: np.ndarray, r: np.ndarray, b: np.ndarray, p: int, q: int, horizon: int) -> np.ndarray:
    h, e = list(y), list(r)
    out = []
    for _ in range(horizon):
        v = b[0] + sum(b[k] * h[-k] for k in range(1, p + 1)) + sum(b[p + k] * e[-k] for k in range(1, q + 1))
        out.append(v)
        h.append(v)
        e.append(0.0)
    return np.array(out)


def arma_ensemble(y: np.ndarray, horizon: int, orders=((0, 0), (1, 0), (0, 1), (1, 1), (2, 1))) -> tuple[np.ndarray, list[float]]:
    """Forecasts averaged by exp(-AICc/2) weights."""
    fits = []
    for p, q in orders:
        b, r, aicc = arma(y, p, q)
        fits.append((aicc, arma_path(y, r, b, p, q, horizon)))
    a = np.array([f[0] for f in fits])
    w = np.exp(-0.5 * (a - a.min()))
    w /= w.sum()
    return sum(wi * f for wi, (_, f) in zip(w, fits, strict=True)), w.tolist()


def garch(r: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """GARCH(1,1) by variance targeting and a shrinking grid over (alpha, beta): omega, alpha, beta, variances. The grid's
    candidates run through the recurrence together."""
    v = float(r.var()) + 1e-16
    sq = (r * r).tolist()

    def paths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.empty((len(sq), len(a)))
        s[0] = v
        w = v * (1 - a - b)
        for t in range(1, len(sq)):
            s[t] = w + a * sq[t - 1] + b * s[t - 1]
        return s

    best, span = (0.05, 0.9), 0.1
    step = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], float)
    for _ in range(8):
        ab = np.array(best) + span * step
        ab = ab[(ab >= 0).all(1) & (ab.sum(1) < 0.999)]
        s = paths(ab[:, 0], ab[:, 1])
        best = tuple(ab[(np.log(s) + np.array(sq)[:, None] / s).sum(0).argmin()])
        span *= 0.6
    a, b = map(float, best)
    return v * (1 - a - b), a, b, paths(np.array([a]), np.array([b]))[:, 0]


def garch_forecast(omega: float, a: float, b: float, last_var: float, last_r: float, horizon: int) -> np.ndarray:
    out = np.empty(horizon)
    s = omega + a * last_r**2 + b * last_var
    for h in range(horizon):
        out[h] = s
        s = omega + (a + b) * s
    return out


def garch_or_ewma(r: np.ndarray, horizon: int) -> np.ndarray:
    """Variance forecast: GARCH where it is stationary and there is data enough, else EWMA 0.94."""
    if len(r) >= 60:
        w, a, b, s = garch(r)
        if a + b < 0.998:
            return garch_forecast(w, a, b, s[-1], r[-1], horizon)
    w = 0.94 ** np.arange(len(r) - 1, -1, -1)
    return np.full(horizon, float((w * r * r).sum() / w.sum()))


def two_regimes(r: np.ndarray, steps: int = 60) -> dict:
    """Two-state Gaussian hidden Markov model of volatility by expectation-maximisation."""
    n, sd = len(r), float(r.std()) + 1e-12
    s0, s1, p, q, pi = 0.5 * sd, 1.8 * sd, 0.95, 0.9, 0.7
    old = -math.inf
    post = np.full((n, 2), 0.5)
    for _ in range(steps):
        l0 = (np.exp(-0.5 * (r / s0) ** 2) / s0 + 1e-300).tolist()
        l1 = (np.exp(-0.5 * (r / s1) ** 2) / s1 + 1e-300).tolist()
        f0, c = [0.0] * n, [0.0] * n
        x, y = pi * l0[0], (1 - pi) * l1[0]
        c[0] = x + y
        f0[0] = x / c[0]
        for t in range(1, n):
            a = f0[t - 1]
            x, y = (a * p + (1 - a) * (1 - q)) * l0[t], (a * (1 - p) + (1 - a) * q) * l1[t]
            c[t] = x + y
            f0[t] = x / c[t]
        g0 = g1 = 1.0
        post0 = [0.0] * n
        post0[-1] = f0[-1]
        stay0 = go0 = stay1 = go1 = 0.0
        for t in range(n - 2, -1, -1):
            u, w = l0[t + 1] * g0 / c[t + 1], l1[t + 1] * g1 / c[t + 1]
            a = f0[t]
            stay0, go0 = stay0 + a * p * u, go0 + a * (1 - p) * w
            stay1, go1 = stay1 + (1 - a) * q * w, go1 + (1 - a) * (1 - q) * u
            g0, g1 = p * u + (1 - p) * w, (1 - q) * u + q * w
            x, y = a * g0, (1 - a) * g1
            post0[t] = x / (x + y)
        p, q, pi = stay0 / max(stay0 + go0, 1e-300), stay1 / max(stay1 + go1, 1e-300), post0[0]
        z = np.array(post0)
        s0, s1 = math.sqrt(z @ (r * r) / max(z.sum(), 1e-300)) + 1e-12, math.sqrt((1 - z) @ (r * r) / max((1 - z).sum(), 1e-300)) + 1e-12
        post = np.column_stack([z, 1 - z])
        now = float(np.log(c).sum())
        if now - old < 1e-6:
            break
        old = now
    order = np.argsort([s0, s1])
    return {"sigma": np.array([s0, s1])[order], "stay": np.array([p, q])[order], "last": post[-1][order], "loglik": old}


def gpd_tail(r: np.ndarray, q: float = 0.95, least: int = 10) -> tuple[float, float, float] | None:
    """Probability-weighted moments of the excess losses over their q-quantile: threshold, shape, scale."""
    loss = -r
    u = np.quantile(loss, q)
    x = np.sort(loss[loss > u] - u)
    if len(x) < least:
        return None
    b0 = x.mean()
    b1 = (x * (len(x) - 1 - np.arange(len(x))) / max(len(x) - 1, 1)).mean()
    shape = 2 - b0 / max(b0 - 2 * b1, 1e-12)
    return float(u), float(np.clip(shape, -0.5, 0.9)), float(max(2 * b0 * b1 / max(b0 - 2 * b1, 1e-12), 1e-12))


def stochastic_volatility(r: np.ndarray) -> tuple[float, float, float]:
    """Log-variance autoregression from log squared returns, noise variance pi^2/2 removed: mean, persistence, deviation."""
    h = np.log(r * r + 1e-8) + 1.27
    d = h - h.mean()
    c0, c1 = float((d * d).mean()), float((d[1:] * d[:-1]).mean())
    phi = float(np.clip(c1 / max(c0 - math.pi**2 / 2, 1e-6), 0, 0.99)) if c0 > math.pi**2 / 2 else 0.0
    return float(h.mean()), phi, math.sqrt(max(c0 - math.pi**2 / 2, 0) * (1 - phi * phi))


def tvp_kalman(y: np.ndarray, x: np.ndarray, q: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Time-varying coefficients: filtered path and last covariance."""
    n, k = x.shape
    b, p, r = np.zeros(k), np.eye(k), float(y.var()) + 1e-12
    out = np.empty((n, k))
    for t in range(n):
        p = p + q * np.eye(k)
        s = x[t] @ p @ x[t] + r
        g = p @ x[t] / s
        b = b + g * (y[t] - x[t] @ b)
        p = p - np.outer(g, x[t]) @ p
        out[t] = b
    return out, p


def quantile_regression(x: np.ndarray, y: np.ndarray, q: float, steps: int = 60) -> np.ndarray:
    """Iteratively reweighted least squares on the check loss."""
    z = np.column_stack([np.ones(len(x)), x])
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    for _ in range(steps):
        e = y - z @ b
        w = np.where(e >= 0, q, 1 - q) / np.maximum(np.abs(e), 1e-6)
        new = np.linalg.solve((z * w[:, None]).T @ z + 1e-10 * np.eye(z.shape[1]), (z * w[:, None]).T @ y)
        if np.abs(new - b).max() < 1e-9:
            break
        b = new
    return b


def pinball(y: np.ndarray, f: np.ndarray, q: float) -> float:
    return float(np.maximum(q * (y - f), (q - 1) * (y - f)).mean())


#: The grid of a dynamic conditional correlation.
DCC_GRID = [(a, b) for a in (0.01, 0.03, 0.06) for b in (0.85, 0.92, 0.95) if a + b < 1]


def dcc_path(u: np.ndarray, a: float, b: float, s: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Minus twice the log-likelihood of (a, b), but for constants, and the last correlation."""
    s = np.corrcoef(u.T) if s is None else s
    q, total = s.copy(), 0.0
    for t in range(len(u)):
        d = np.sqrt(np.diag(q))
        c = q / np.outer(d, d)
        _, logdet = np.linalg.slogdet(c)
        total += logdet + u[t] @ np.linalg.solve(c + 1e-9 * np.eye(len(c)), u[t])
        q = (1 - a - b) * s + a * np.outer(u[t], u[t]) + b * q
    d = np.sqrt(np.diag(q))
    return total, q / np.outer(d, d)


def dcc(u: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Dynamic conditional correlation of standardised residuals by a grid on (a, b): a, b, last correlation."""
    s = np.corrcoef(u.T)
    best = min((dcc_path(u, a, b, s)[0], a, b) for a, b in DCC_GRID)
    return best[1], best[2], dcc_path(u, best[1], best[2], s)[1]


def dcc_factors(u: np.ndarray, a: float, b: float) -> np.ndarray:
    """The last correlation of ``dcc_path`` as y y', one row of y an asset, each from its own residuals alone (dates x assets).
    An asset without variance has a row of zeros."""
    t = len(u)
    w = a * b ** np.arange(t - 1, -1, -1)
    rest = b**t + (1 - a - b) * (1 - b**t) / (1 - b)
    y = np.concatenate([math.sqrt(rest / t) * (u - u.mean(0)) / np.maximum(u.std(0), 1e-300), np.sqrt(w)[:, None] * u]).T
    return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-300)


def isotonic(x: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    blocks: list[list[float]] = []
    for v in x:
        blocks.append([float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, n in blocks])


def quantile_map(samples: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Monotone piecewise-linear map of quantiles, ends shifted."""
    out = np.interp(samples, source, target)
    out = np.where(samples < source[0], samples - source[0] + target[0], out)
    return np.where(samples > source[-1], samples - source[-1] + target[-1], out)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        d = ((x[:, None, :] - c[None]) ** 2).sum(-1)
        lab = d.argmin(1)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return lab, c


def pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Standardised, 0.1 / 99.9 % clipped components: scores, loadings, mean, deviation."""
    mu, sd = x.mean(0), x.std(0) + 1e-12
    z = (x - mu) / sd
    z = np.clip(z, *np.quantile(z, [0.001, 0.999], axis=0))
    _, _, v = np.linalg.svd(z, full_matrices=False)
    return z @ v[:k].T, v[:k], mu, sd


def n_components(x: np.ndarray, most: int) -> int:
    """Bai-Ng information criterion."""
    n, k = x.shape
    z = (x - x.mean(0)) / (x.std(0) + 1e-12)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    total = (z**2).mean()
    ic = [math.log(max(total - (s[:j] ** 2).sum() / (n * k), 1e-12)) + j * (n + k) / (n * k) * math.log(n * k / (n + k)) for j in range(1, most + 1)]
    return int(np.argmin(ic)) + 1


def edgeworth(z: np.ndarray, skew: float, kurt: float) -> np.ndarray:
    """Normal draws with third and fourth moments, standardised again."""
    cube = (kurt - 3) / 24 - skew**2 / 18
    square = z * z
    # The polynomial of z by powers, less its constant, which the mean takes out; z**3 would be a call of pow a draw.
    e = (cube * square + (1 - (kurt - 3) / 8 + 5 * skew**2 / 36)) * z
    square *= skew / 6
    e += square
    e -= e.mean()
    e /= max(math.sqrt(e @ e / len(e)), 1e-12)
    return e


def truncated_normal(mu: float, sd: float, low: float, high: float, n: int, rng: np.random.Generator) -> np.ndarray:
    out = np.empty(0)
    for _ in range(200):
        x = rng.normal(mu, max(sd, 1e-12), 2 * n)
        out = np.r_[out, x[(x >= low) & (x <= high)]]
        if len(out) >= n:
            return out[:n]
    return np.r_[out, rng.uniform(low, high, n - len(out))]


def pert(low: float, mode: float, high: float, n: int, rng: np.random.Generator, lam: float = 4.0) -> np.ndarray:
    mode = min(max(mode, low + 1e-9), high - 1e-9)
    span = high - low
    return low + span * rng.beta(1 + lam * (mode - low) / span, 1 + lam * (high - mode) / span, n)


def stable_quantiles(simulate, least: int = 500, most: int = 8000, step: int = 500, tol: float = 0.01) -> np.ndarray:
    """Grows a sample until its median and 95 % quantile settle."""
    x = simulate(least)
    old = np.quantile(x, [0.5, 0.95])
    while len(x) < most:
        x = np.r_[x, simulate(step)]
        now = np.quantile(x, [0.5, 0.95])
        if np.abs(now - old).max() <= tol * max(np.abs(now).max(), 1e-9):
            break
        old = now
    return x


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def return_paths(prices: DataFrame, horizon: int = 52, sims: int = 500, seed: int = 1, least: int = 60, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Per symbol: ARMA-ensemble drift, GARCH variance, block-bootstrapped shocks; quantiles of the clipped price at the horizon.
    prices: symbol, date, close (weekly)."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        c = x["close"].dropna().to_numpy(float)
        if len(c) < least:
            return []
        r, rng = np.diff(np.log(c)), rng_for(seed, symbol)
        mean, _ = arma_ensemble(r, horizon)
        var = garch_or_ewma(r - r.mean(), horizon)
        z = (r - r.mean()) / (r.std() + 1e-12)
        draws = z[np.stack([E.block_indices(len(z), horizon, 4, rng) for _ in range(sims)])]
        end = np.clip(c[-1] * np.exp((mean + np.sqrt(var) * draws).sum(1)), low * c[-1], high * c[-1])
        q = np.quantile(end, QUANTILES)
        ret = end / c[-1] - 1
        return [(symbol, float(c[-1]), *map(float, q), float(ret.mean()), float(ret.std(ddof=1)))]

    return G.per_symbol(prices.select("symbol", "date", "close"), "symbol", "date", "symbol {key}, price double, p05 double, p25 double, p50 double, p75 double, p95 double, ret double, se double", run)


def volatility_models(returns: DataFrame, least: int = 60) -> DataFrame:
    """GARCH, regime, stochastic-volatility and tail parameters of each symbol."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        r = x["ret"].dropna().to_numpy(float)
        if len(r) < least:
            return []
        r = r - r.mean()
        w, a, b, s = garch(r)
        h, sv, tail = two_regimes(r), stochastic_volatility(r), gpd_tail(r, 0.9)
        return [(symbol, float(a), float(b), float(math.sqrt(s[-1])), float(h["sigma"][0]), float(h["sigma"][1]), float(h["stay"][1]), sv[1], tail[1] if tail else None, tail[2] if tail else None)]

    return G.per_symbol(returns.select("symbol", "date", "ret"), "symbol", "date", "symbol {key}, alpha double, beta double, sigma double, calm double, stress double, stay double, sv_phi double, tail_shape double, tail_scale double", run)


def trend_forecasts(prices: DataFrame, horizon: int = 26, least: int = 80) -> DataFrame:
    """Trend-and-season forecasts with residual ARMA and variance, and the rolling-origin error."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        y = np.log(x["close"].dropna().to_numpy(float))
        if len(y) < least:
            return []
        fit, fc, sd = trend_season(y, horizon)
        res, _ = arma_ensemble(y - fit, horizon)
        errs = []
        for cut in range(int(0.6 * len(y)), len(y) - horizon, horizon):
            _, f, _ = trend_season(y[:cut], horizon)
            errs.append(float(((f - y[cut : cut + horizon]) ** 2).mean()))
        return [(symbol, float(np.exp(fc[-1] + res[-1])), float(np.exp(y[-1])), sd, math.sqrt(np.mean(errs)) if errs else None, adf_order(y))]

    return G.per_symbol(prices.select("symbol", "date", "close"), "symbol", "date", "symbol {key}, forecast double, last double, sd double, cv_rmse double, d int", run)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.1, rng: np.random.Generator | None = None) -> list:
    """Gradient boosting of depth-1 trees on squared loss: (base, [(column, cut, left, right)])."""
    f = np.full(len(y), y.mean())
    trees = []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.1, 0.9, 9))) for j in range(x.shape[1])]
    for _ in range(rounds):
        e = y - f
        best = None
        for j, cs in enumerate(cuts):
            for c in cs:
                left = x[:, j] <= c
                if 0 < left.sum() < len(y):
                    a, b = e[left].mean(), e[~left].mean()
                    gain = left.sum() * a * a + (~left).sum() * b * b
                    if best is None or gain > best[0]:
                        best = (gain, j, c, a, b)
        if best is None:
            break
        _, j, c, a, b = best
        f += rate * np.where(x[:, j] <= c, a, b)
        trees.append((j, c, rate * a, rate * b))
    return [float(y.mean()), trees]


def boosted_predict(model: list, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model[0])
    for j, c, a, b in model[1]:
        out += np.where(x[:, j] <= c, a, b)
    return out


def return_regressions(panel: DataFrame, features: list[str], boots: int = 20, seed: int = 3, least: int = 40) -> DataFrame:
    """Bootstrapped boosted trees of the next return on features (ridge under eight rows a feature): P10, median, P90 of the
    prediction from the last row. panel: symbol, date, target, features."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        last = x[features].dropna().tail(1).to_numpy(float)
        d = x.dropna(subset=[*features, "target"])
        if len(d) < least or not len(last):
            return []
        xs, y, rng = d[features].to_numpy(float), d["target"].to_numpy(float), rng_for(seed, symbol)
        preds = [boosted_predict(boosted(xs[i], y[i], 30), last)[0] for i in (E.block_indices(len(y), len(y), 8, rng) for _ in range(boots))]
        q = np.quantile(preds, [0.1, 0.5, 0.9])
        return [(symbol, len(d), *map(float, q), float(np.std(preds, ddof=1)))]

    return G.per_symbol(panel.select("symbol", "date", "target", *features), "symbol", "date", "symbol {key}, n long, p10 double, p50 double, p90 double, se double", run)


def macro_paths(levels: DataFrame, cols: list[str], horizon: int = 4, sims: int = 1000, seed: int = 5, p: int = 1) -> DataFrame:
    """Bayesian VAR of each country's series: mean and quantiles of the simulated paths by step and variable."""

    def run(country, x: pd.DataFrame) -> list[tuple]:
        y = x[cols].dropna().to_numpy(float)
        if len(y) < 12:
            return []
        const, coef, cov = E.fit_bvar(y, p)
        paths = E.simulate_var(const, coef, y, E.shocks(cov, horizon, sims, rng_for(seed, country), "student"))
        return [(country, t + 1, c, float(paths[:, t, j].mean()), *map(float, np.quantile(paths[:, t, j], [0.05, 0.5, 0.95]))) for t in range(horizon) for j, c in enumerate(cols)]

    return G.per_symbol(levels.select("country", "date", *cols), "country", "date", "country long, step int, variable string, mean double, p05 double, p50 double, p95 double", run)


def gbm_terminal(spark: SparkSession, params: DataFrame, scenarios: int, steps: int = 52, seed: int = 7, block: int = 10_000) -> DataFrame:
    """Terminal prices of geometric Brownian motions with Edgeworth shocks: (symbol, block, mean, sd, p05, p50, p95, loss) per block
    of scenarios, so any number of scenarios is spread over tasks. params: symbol, mu, sigma, skew, kurt, price."""
    blocks = -(-scenarios // block)
    rows = params.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # A fixed number: adaptive execution would join so small rows in one task, whatever their work.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol", "block")

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                n = min(block, scenarios - r.block * block)
                rng = G.seeded(seed, r.symbol, int(r.block))
                z = np.zeros(n)
                for _ in range(steps):
                    z += edgeworth(rng.standard_normal(n), r.skew, r.kurt)
                end = r.price * np.exp((r.mu - r.sigma**2 / 2) + r.sigma * z / math.sqrt(steps))
                out.append((r.symbol, r.block, n, float(end.mean()), float(end.std()), *map(float, np.quantile(end, [0.05, 0.5, 0.95])), float((end < r.price).mean())))
            yield pd.DataFrame(out, columns=["symbol", "block", "n", "mean", "sd", "p05", "p50", "p95", "loss"])

    return rows.mapInPandas(run, f"symbol {params.schema['symbol'].dataType.simpleString()}, block int, n int, mean double, sd double, p05 double, p50 double, p95 double, loss double")


def dividend_yields(params: DataFrame, sims: int = 2000, seed: int = 9) -> DataFrame:
    """Simulated yields: PERT earnings x truncated-normal payout over price. params: symbol, price, eps_low, eps_avg, eps_high, payout,
    payout_sd."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples():
                rng = rng_for(seed, r.symbol)
                y = pert(r.eps_low, r.eps_avg, max(r.eps_high, r.eps_low + 1e-6), sims, rng) * truncated_normal(r.payout, r.payout_sd, 0.0, 1.0, sims, rng) / r.price
                out.append((r.symbol, float(y.mean()), float(y.std(ddof=1)), *map(float, np.quantile(y, [0.1, 0.5, 0.9]))))
            yield pd.DataFrame(out, columns=["symbol", "mean", "sd", "p10", "p50", "p90"])

    return params.mapInPandas(run, f"symbol {params.schema['symbol'].dataType.simpleString()}, mean double, sd double, p10 double, p50 double, p90 double")


def neighbours(returns: DataFrame, k: int = 5, least: int = 30) -> DataFrame:
    """The k most correlated symbols of each, with weights |rho| / sum: edges (src, dst, rho, weight)."""
    return with_weights(M.most_correlated(M.packed(returns), k, least))


def with_weights(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "rho", (F.abs("rho") / F.sum(F.abs("rho")).over(Window.partitionBy("src"))).alias("weight"))


def direct_quantiles(panel: DataFrame, features: list[str], quantiles=(0.1, 0.5, 0.9), least: int = 60) -> DataFrame:
    """Quantile regressions of a forward target on features, read at the last row; crossings removed by isotonic order."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        last = x[features].dropna().tail(1).to_numpy(float)
        d = x.dropna(subset=[*features, "target"])
        if len(d) < least or not len(last):
            return []
        xs, y = d[features].to_numpy(float), d["target"].to_numpy(float)
        sd = xs.std(0) + 1e-12
        q = isotonic(np.array([(b := quantile_regression(xs / sd, y, p))[0] + (last[0] / sd) @ b[1:] for p in quantiles]))
        return [(symbol, len(d), *map(float, q))]

    cols = ", ".join(f"q{int(100 * q):02d} double" for q in quantiles)
    return G.per_symbol(panel.select("symbol", "date", "target", *features), "symbol", "date", f"symbol {{key}}, n long, {cols}", run)


def peer_features(returns: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """Lagged cross-asset features: leave-one-out means of the market and of the group, and the mean of the k most correlated
    peers. groups: symbol, grp."""
    table = M.packed(returns, label="peers")
    edges = stored(returns.sparkSession, M.most_correlated(table, k), "edges", clean=True)
    rows = J.leave_one_out(peer_means(table, edges).join(groups, "symbol"), "ret", ["grp", "date"], "group_mean")
    # One row a date: the market's sums, each row's own taken out as ``leave_one_out`` does.
    market = rows.groupBy("date").agg(F.sum("ret").alias("_s"), F.count("ret").alias("_n"))
    n = F.col("_n") - F.col("ret").isNotNull().cast("int")
    rows = rows.join(F.broadcast(market), "date").withColumn("market", F.when(n > 0, (F.col("_s") - F.coalesce("ret", F.lit(0.0))) / n))
    w = P.over("symbol")
    return rows.select("symbol", "date", "ret", *[F.lag(c).over(w).alias(f"{c}_l1") for c in ("market", "group_mean", "peers")])


def peer_means(table: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, date, ret, peers): each row of the packed table unpacked, with the mean of its peers' known returns of the date.

    Histories travel as arrays, one row an edge, and are averaged where they meet.
    """
    of = edges.select("src", "dst").join(table.select(F.col("s").alias("dst"), "dates", "rets"), "dst")
    of = of.groupBy("src").agg(F.collect_list(F.struct("dates", "rets")).alias("x"))
    both = table.join(of.withColumnRenamed("src", "s"), "s", "left").select("s", "dates", "rets", F.col("x.dates").alias("peer_dates"), F.col("x.rets").alias("peer_rets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.slice(first, 256)
                counts = np.diff(batch["rets"].offsets.to_numpy())
                out = np.full(int(counts.sum()), np.nan)
                ends = np.cumsum(counts)
                for i, n in enumerate(counts):
                    if not batch["peer_rets"][i].is_valid or not len(batch["peer_rets"][i]):
                        continue
                    own = batch["dates"][i].values.to_numpy(zero_copy_only=False)
                    dates = batch["peer_dates"][i].values.flatten().to_numpy(zero_copy_only=False)
                    rets = batch["peer_rets"][i].values.flatten().to_numpy(zero_copy_only=False)
                    at = np.searchsorted(own, dates)
                    ok = (at < n) & ~np.isnan(rets)
                    ok[ok] = own[at[ok]] == dates[ok]
                    known = np.bincount(at[ok], minlength=n)
                    with np.errstate(invalid="ignore"):
                        out[ends[i] - n : ends[i]] = np.bincount(at[ok], rets[ok], minlength=n) / known
                yield pa.RecordBatch.from_arrays([batch["s"].take(np.repeat(np.arange(len(batch)), counts)), batch["dates"].flatten(), batch["rets"].flatten(), pa.array(out, from_pandas=True)], ["symbol", "date", "ret", "peers"])

    kind, day = table.schema["s"].dataType.simpleString(), table.schema["dates"].dataType.elementType.simpleString()
    return both.mapInArrow(run, f"symbol {kind}, date {day}, ret double, peers double")


def joint_paths(returns: DataFrame, horizon: int = 13, sims: int = 500, seed: int = 11, most_assets: int = 500) -> DataFrame:
    """Joint simulation of a universe: GARCH variances per asset, dynamic correlations across, Student shocks; quantiles of each
    asset's return and of the equal-weight holdings (symbol -1, or * among strings). Up to ``most_assets`` the panel is gathered;
    beyond, ``factored_paths`` keeps it in tasks."""
    spark = returns.sparkSession
    if returns.select("symbol").distinct().count() > most_assets:
        return factored_paths(returns, horizon, sims, seed)
    wide = returns.select("symbol", "date", "ret").toPandas().pivot(index="date", columns="symbol", values="ret").dropna(axis=1, thresh=30).fillna(0.0)
    r = wide.to_numpy()
    d = r - r.mean(0)
    fits = [garch(d[:, j]) for j in range(d.shape[1])]
    u = np.column_stack([d[:, j] / np.sqrt(f[3]) for j, f in enumerate(fits)])
    _, _, corr = dcc(u)
    e = E.shocks(E.psd(corr), horizon, sims, np.random.default_rng(seed), "student")
    var = np.column_stack([garch_forecast(f[0], f[1], f[2], f[3][-1], d[-1, j], horizon) for j, f in enumerate(fits)])
    total = np.prod(1 + np.clip(r.mean(0) + e * np.sqrt(var), -0.99, None), axis=1) - 1
    cols = np.column_stack([total, total.mean(1)])
    kind = returns.schema["symbol"].dataType.simpleString()
    names = [*wide.columns.tolist(), "*" if kind == "string" else -1]
    return spark.createDataFrame([(s, *map(float, np.quantile(cols[:, j], [0.05, 0.5, 0.95])), float(cols[:, j].mean())) for j, s in enumerate(names)], f"symbol {kind}, p05 double, p50 double, p95 double, mean double")


#: Assets of one likelihood of the correlations' dynamics, and assets that are simulated at once.
DCC_BLOCK, PATHS_BLOCK = 64, 256


def factored_paths(returns: DataFrame, horizon: int, sims: int, seed: int, df: float = 6.0, block: int = DCC_BLOCK) -> DataFrame:
    """``joint_paths`` of any universe, without a matrix of assets x assets and without the panel on the driver.

    The last correlation is y y' with a row of y from each asset's own residuals (``dcc_factors``), so the joint shocks of an asset
    are its row times normals that all tasks draw alike from the seed. With more assets than dates the joint density of all does
    not exist, so (a, b) maximise a composite likelihood: the sum of those of blocks of assets, every asset in one block (dealt by
    its hash and the number of assets). The holdings' paths are summed over the assets.
    """
    spark = returns.sparkSession
    kind = returns.schema["symbol"].dataType.simpleString()
    every = M.packed(returns, label="joint")
    calendar = every.select(F.explode("dates").alias("d")).distinct().toArrow()["d"].to_numpy()
    calendar.sort()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.size(F.filter("rets", lambda x: x.isNotNull() & ~F.isnan(x))) >= 30

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), PATHS_BLOCK):
                batch = whole.slice(first, PATHS_BLOCK)
                out = []
                for i in range(len(batch)):
                    days, x = (batch[c].slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("dates", "rets"))
                    r, at = np.zeros(len(calendar)), np.searchsorted(calendar, days)
                    if len(np.unique(at)) != len(at):
                        raise ValueError("a symbol has two returns on one date")
                    r[at] = np.nan_to_num(x)
                    d = r - r.mean()
                    f = garch(d)
                    out.append((d / np.sqrt(f[3]), r.mean(), garch_forecast(f[0], f[1], f[2], f[3][-1], d[-1], horizon)))
                u, mean, var = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch["s"], pa.array(u, pa.list_(pa.float64())), pa.array(mean), pa.array(var, pa.list_(pa.float64()))], ["s", "u", "mean", "var"])

    fits = stored(spark, every.filter(known).repartition(parts, "s").mapInArrow(residuals, f"s {kind}, u array<double>, mean double, var array<double>"), "joint-fits", clean=True)
    n = fits.count()
    block = max(2, min(block, len(calendar) // 3))

    def likelihood(rows: pd.DataFrame) -> pd.DataFrame:
        u = np.stack(rows.sort_values("s")["u"].to_list(), axis=1)
        u = u[:, u.std(0) > 0]
        s = np.corrcoef(u.T) if u.shape[1] > 1 else np.eye(u.shape[1])
        return pd.DataFrame([(a, b, dcc_path(u, a, b, s)[0]) for a, b in DCC_GRID], columns=["a", "b", "v"])

    blocks = fits.select("s", "u", F.pmod(F.xxhash64("s"), F.lit(-(-n // block))).alias("g")).repartition(parts, "g")
    found = blocks.groupBy("g").applyInPandas(likelihood, "a double, b double, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()
    _, a, b = min((x["v"], x["a"], x["b"]) for x in found)

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        chi = np.sqrt((df - 2) / np.random.default_rng([seed, horizon]).chisquare(df, (horizon, sims, 1)))
        for whole in batches:
            for first in range(0, len(whole), PATHS_BLOCK):
                batch = whole.slice(first, PATHS_BLOCK)
                u, var = (batch[c].flatten().to_numpy().reshape(len(batch), -1).T for c in ("u", "var"))
                mean, y = batch["mean"].to_numpy(), dcc_factors(u, a, b).T
                total = np.ones((sims, len(batch)))
                for h in range(horizon):
                    z = np.random.default_rng([seed, h]).standard_normal((sims, len(y)))
                    total *= 1 + np.clip(mean + (z @ y) * chi[h] * np.sqrt(var[h]), -0.99, None)
                total -= 1
                low, mid, high = np.quantile(total, [0.05, 0.5, 0.95], axis=0)
                yield pd.DataFrame({"symbol": batch["s"].to_pandas(), "p05": low, "p50": mid, "p95": high, "mean": total.mean(0), "part": None})
                yield pd.DataFrame({"symbol": [None], "p05": None, "p50": None, "p95": None, "mean": None, "part": [total.sum(1)]})

    schema = T._parse_datatype_string(f"symbol {kind}, p05 double, p50 double, p95 double, mean double, part array<double>")
    arrow = to_arrow_schema(schema)
    run = lambda batches: (pa.RecordBatch.from_pandas(x, arrow, preserve_index=False) for x in simulate(batches))
    done = stored(spark, fits.repartition(min(parts, -(-n // PATHS_BLOCK)), "s").mapInArrow(run, schema), "joint-paths", clean=True)
    sums = done.filter("part IS NOT NULL").select(F.posexplode("part").alias("k", "x")).groupBy("k").agg((F.sum("x") / n).alias("x"))
    held = sums.agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.avg("x").alias("mean"))
    held = held.select(F.lit("*" if kind == "string" else -1).cast(kind).alias("symbol"), *[F.col("q")[i].alias(c) for i, c in enumerate(("p05", "p50", "p95"))], "mean")
    return done.filter("part IS NULL").drop("part").unionByName(held)

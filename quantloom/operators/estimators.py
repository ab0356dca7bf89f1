"""Statistical estimators: betas, factor regressions, Bayesian VARs, robust regressions, Black-Litterman.

Per-symbol fits run as grouped kernels over one symbol's aligned history; matrix algebra of a few hundred assets or factors
runs on small numpy arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quantloom.functions import grouped as G
from quantloom.operators import metrics as M
from quantloom.operators.metrics import RF_WEEK, newey_west


def winsor(x: np.ndarray, p: float) -> np.ndarray:
    return np.clip(x, *np.quantile(x, [p, 1 - p])) if p and len(x) else x


def ols_beta(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Beta and its Newey-West error, lags 4 (T/100)^(2/9)."""
    lags = max(int(4 * (len(y) / 100) ** (2 / 9)), 1)
    b, se, _ = newey_west(np.column_stack([np.ones(len(x)), x]), y, lags)
    return float(b[1]), float(se[1])


def dimson_beta(y: np.ndarray, x: np.ndarray, span: int = 2) -> tuple[float, float]:
    """Sum of the betas on the market's leads and lags."""
    n = len(y)
    cols = [np.roll(x, k) for k in range(-span, span + 1)]
    keep = slice(span, n - span)
    z = np.column_stack([np.ones(n), *cols])[keep]
    b, *_ = np.linalg.lstsq(z, y[keep], rcond=None)
    e = y[keep] - z @ b
    cov = (e @ e) / max(len(e) - z.shape[1], 1) * np.linalg.pinv(z.T @ z)
    one = np.r_[0, np.ones(2 * span + 1)]
    return float(b[1:].sum()), float(math.sqrt(max(one @ cov @ one, 0)))


def kalman_beta(y: np.ndarray, x: np.ndarray, q: float = 1e-4, r: float | None = None) -> tuple[float, float, np.ndarray]:
    """Random-walk beta: filter, then Rauch-Tung-Striebel smoother; last value, its error, and the smoothed path."""
    r = float(np.var(y)) if r is None else r
    n = len(y)
    m, p = np.empty(n), np.empty(n)
    b, v = 1.0, 1.0
    for t in range(n):
        v += q
        k = v * x[t] / (x[t] * x[t] * v + r)
        b += k * (y[t] - x[t] * b)
        v *= 1 - k * x[t]
        m[t], p[t] = b, v
    s, sv = m.copy(), p.copy()
    for t in range(n - 2, -1, -1):
        c = p[t] / (p[t] + q)
        s[t] += c * (s[t + 1] - m[t])
        sv[t] += c * c * (sv[t + 1] - p[t] - q)
    return float(s[-1]), float(math.sqrt(sv[-1])), s


def inverse_variance(values: list[float], errors: list[float], prefer: list[float] | None = None) -> tuple[float, float]:
    w = np.array([(1 / max(e, 1e-8) ** 2) * p for e, p in zip(errors, prefer or [1.0] * len(errors), strict=True)])
    return float(w @ np.array(values) / w.sum()), float(math.sqrt(1 / w.sum()))


def betas(returns: DataFrame, bench: DataFrame, p: float = 0.01, least: int = 30) -> DataFrame:
    """OLS, Dimson and Kalman betas of each symbol and their precision-weighted mean."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        x = x.dropna()
        if len(x) < least:
            return []
        y, m = winsor(x["ret"].to_numpy() - RF_WEEK, p), winsor(x["bench"].to_numpy() - RF_WEEK, p)
        b1, s1 = ols_beta(y, m)
        b2, s2 = dimson_beta(y, m)
        b3, s3, _ = kalman_beta(y, m)
        b, s = inverse_variance([b1, b2, b3], [s1, s2, s3])
        return [(symbol, b1, s1, b2, s2, b3, s3, b, s)]

    schema = "symbol {key}, beta_ols double, se_ols double, beta_dimson double, se_dimson double, beta_kalman double, se_kalman double, beta double, se double"
    return G.per_symbol(returns.join(bench, "date").select("symbol", "date", "ret", "bench"), "symbol", "date", schema, run)


def residualise(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y less its projection on x and a constant (Frisch-Waugh-Lovell)."""
    z = np.column_stack([np.ones(len(y)), x])
    return y - z @ np.linalg.lstsq(z, y, rcond=None)[0]


def partial_betas(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Beta of each regressor after the others are partialled out of both sides."""
    out = []
    for j in range(x.shape[1]):
        rest = np.delete(x, j, axis=1)
        out.append(float(residualise(y, rest) @ residualise(x[:, j], rest) / max(residualise(x[:, j], rest) @ residualise(x[:, j], rest), 1e-300)))
    return np.array(out)


def factor_regression(panel: DataFrame, factors: list[str], expected: dict[str, float], least: int = 60) -> DataFrame:
    """Robust regression of each symbol on factors: expected return and error from expected factor returns. panel: symbol,
    date, ret and factor columns."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        x = x.dropna()
        if len(x) < least:
            return []
        z = np.column_stack([np.ones(len(x)), x[factors].to_numpy()])
        b, se, e = newey_west(z, x["ret"].to_numpy() - RF_WEEK, max(int(4 * (len(x) / 100) ** (2 / 9)), 1))
        f = np.array([expected[n] for n in factors])
        y = x["ret"].to_numpy()
        r2 = 1 - (e @ e) / max(((y - y.mean()) ** 2).sum(), 1e-300)
        return [(symbol, len(x), float(RF_WEEK * 52 + b[1:] @ f), float(math.sqrt((se[1:] ** 2) @ f**2 + e.var(ddof=z.shape[1]) * 52)), float(r2), [float(v) for v in b[1:]])]

    return G.per_symbol(panel.select("symbol", "date", "ret", *factors), "symbol", "date", "symbol {key}, n long, exp_return double, se double, r2 double, loadings array<double>", run)


def huber_enet(x: np.ndarray, y: np.ndarray, lam: float, alpha: float, m: float, nonneg: bool = False, steps: int = 500) -> np.ndarray:
    """Huber loss with L1 and L2 penalties by accelerated proximal gradients on standardised columns; intercept first."""
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z, yc = (x - mu) / sd, y - np.median(y)
    scale = max(np.median(np.abs(yc - np.median(yc))) * 1.4826, 1e-12)
    yc = yc / scale
    n = len(y)
    step = 1 / (np.linalg.norm(z, 2) ** 2 / n + lam * (1 - alpha) + 1)
    b = np.zeros(x.shape[1])
    a, v, c = 0.0, b.copy(), 1.0
    for _ in range(steps):
        r = np.clip(z @ v + a - yc, -m, m)
        a -= step * r.mean()
        g = v - step * (z.T @ r / n + lam * (1 - alpha) * v)
        new = np.sign(g) * np.maximum(np.abs(g) - step * lam * alpha, 0)
        if nonneg:
            new = np.maximum(new, 0)
        c2 = (1 + math.sqrt(1 + 4 * c * c)) / 2
        v = new + (c - 1) / c2 * (new - b)
        if np.abs(new - b).max() < 1e-10:
            b = new
            break
        b, c = new, c2
    beta = b * scale / sd
    return np.r_[a * scale + np.median(y) - mu @ beta, beta]


def huber_loss(y: np.ndarray, f: np.ndarray, m: float) -> float:
    r = np.abs(y - f)
    return float(np.mean(np.where(r <= m, 0.5 * r * r, m * (r - 0.5 * m))))


def time_splits(n: int, k: int, least_train: int, least_test: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Expanding windows with at least so many rows to fit and to test."""
    size = max((n - least_train) // k, least_test) if n > least_train else 0
    out = []
    for i in range(k):
        a = least_train + i * size
        if size and a + least_test <= n:
            out.append((np.arange(a), np.arange(a, min(a + size, n))))
    return out


def huber_enet_cv(x: np.ndarray, y: np.ndarray, lams=(0.0, 0.01, 0.1, 1.0), alphas=(0.0, 0.5, 1.0), ms=(1.0, 1.5), splits: int = 3, nonneg: bool = False) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Grid, then a refinement around its best, scored by Huber loss over expanding windows."""
    folds = time_splits(len(y), splits, max(8, len(y) // 3), 2) or [(np.arange(len(y)), np.arange(len(y)))]

    def score(lam, alpha, m):
        losses = []
        for tr, te in folds:
            b = huber_enet(x[tr], y[tr], lam, alpha, m, nonneg)
            losses.append(huber_loss(y[te], b[0] + x[te] @ b[1:], m * max(np.std(y[tr]), 1e-12)))
        return float(np.mean(losses))

    best = min(((score(la, al, m), la, al, m) for la in lams for al in alphas for m in ms))
    near = [(score(la, best[2], best[3]), la, best[2], best[3]) for la in (best[1] * 0.3, best[1] * 3) if la > 0]
    best = min([best, *near])
    return huber_enet(x, y, *best[1:], nonneg), best[1:]


def lagged(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows [1, y(t-1), ..., y(t-p)] and the targets."""
    t = len(y)
    return np.column_stack([np.ones(t - p), *[y[p - k : t - k] for k in range(1, p + 1)]]), y[p:]


def companion_radius(a: np.ndarray, k: int) -> float:
    """Spectral radius of the companion matrix of k x kp coefficients."""
    p = a.shape[1] // k
    c = np.zeros((k * p, k * p))
    c[:k] = a
    c[k:, :-k] = np.eye(k * (p - 1))
    return float(np.abs(np.linalg.eigvals(c)).max())


def stable(a: np.ndarray, k: int, most: float = 0.98) -> np.ndarray:
    while companion_radius(a, k) > most:
        a = a * 0.9
    return a


def fit_bvar(y: np.ndarray, p: int = 2, overall: float = 0.2, cross: float = 0.5, decay: float = 1.0, own: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minnesota prior as a ridge per equation: intercepts, lag coefficients (k x kp), residual covariance."""
    x, z = lagged(y, p)
    k = y.shape[1]
    sigma = np.array([residualise(z[:, i], x[:, 1 + i : 2 + i]).std(ddof=1) + 1e-12 for i in range(k)])
    const, coef, resid = np.empty(k), np.empty((k, k * p)), np.empty_like(z)
    for i in range(k):
        pen, mean = np.zeros(1 + k * p), np.zeros(1 + k * p)
        for lag in range(1, p + 1):
            for j in range(k):
                sd = overall * sigma[i] / sigma[j] / lag**decay * (1.0 if i == j else cross)
                pen[1 + (lag - 1) * k + j] = (sigma[i] / max(sd, 1e-12)) ** 2
        mean[1 + i] = own
        b = np.linalg.solve(x.T @ x + np.diag(pen) + 1e-10 * np.eye(len(pen)), x.T @ z[:, i] + pen * mean)
        const[i], coef[i], resid[:, i] = b[0], b[1:], z[:, i] - x @ b
    return const, stable(coef, k), np.cov(resid.T).reshape(k, k)


def tune_bvar(y: np.ndarray, lags=(1, 2), overall=(0.1, 0.2, 0.5), cross=(0.5, 1.0), own=(0.0, 0.5, 0.8), origins: int = 4) -> dict:
    """Hyperparameters with the least rolling-origin error of one-step forecasts."""
    best = None
    for p in lags:
        for o in overall:
            for c in cross:
                for w in own:
                    err = 0.0
                    for cut in range(len(y) - origins, len(y)):
                        a, b, _ = fit_bvar(y[:cut], p, o, c, 1.0, w)
                        f = a + b @ np.concatenate([y[cut - j] for j in range(1, p + 1)])
                        err += float(((f - y[cut]) ** 2).mean())
                    if best is None or err < best[0]:
                        best = (err, {"p": p, "overall": o, "cross": c, "own": w})
    return best[1]


def shocks(resid_cov: np.ndarray, steps: int, sims: int, rng: np.random.Generator, kind: str = "gaussian", df: float = 6.0, resid: np.ndarray | None = None, block: int = 4) -> np.ndarray:
    """(sims, steps, k) innovations: normal, Student t scale mixture, or circular block bootstrap of residuals."""
    k = len(resid_cov)
    if kind == "bootstrap" and resid is not None:
        return resid[block_indices(len(resid), steps * sims, block, rng)].reshape(sims, steps, k)
    low = np.linalg.cholesky(psd(resid_cov) + 1e-14 * np.eye(k))
    e = rng.standard_normal((sims, steps, k)) @ low.T
    return e * np.sqrt((df - 2) / rng.chisquare(df, (sims, steps, 1))) if kind == "student" else e


def block_indices(n: int, size: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Circular block bootstrap indices."""
    starts = rng.integers(0, n, -(-size // block))
    return ((starts[:, None] + np.arange(block)) % n).reshape(-1)[:size]


def stationary_indices(n: int, size: int, p: float, rng: np.random.Generator) -> np.ndarray:
    """Politis-Romano: a new start with probability p, else the next row."""
    new = rng.random(size) < p
    new[0] = True
    start = np.where(new, rng.integers(0, n, size), 0)
    run = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    return (start[run] + np.arange(size) - run) % n


def simulate_var(const: np.ndarray, coef: np.ndarray, history: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Paths (sims, steps, k) from the last rows of history and innovations."""
    sims, steps, k = e.shape
    p = coef.shape[1] // k
    past = [np.tile(history[-j], (sims, 1)) for j in range(1, p + 1)]
    out = np.empty_like(e)
    for t in range(steps):
        now = const + np.concatenate(past, axis=1) @ coef.T + e[:, t]
        out[:, t] = now
        past = [now, *past[:-1]]
    return out


def psd(c: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Nearest positive semidefinite matrix by eigenvalues, keeping the diagonal."""
    c = (c + c.T) / 2
    w, v = np.linalg.eigh(c)
    if w.min() >= eps:
        return c
    fixed = (v * np.maximum(w, eps)) @ v.T
    s = np.sqrt(np.maximum(np.diag(c), eps) / np.maximum(np.diag(fixed), eps))
    return fixed * s[:, None] * s[None, :]


def implied_returns(delta: float, sigma: np.ndarray, w: np.ndarray) -> np.ndarray:
    return delta * sigma @ w


def proportional_prior(sigma: np.ndarray, tau: float, p: np.ndarray, confidence: float = 1.0, floor: float = 1e-8) -> np.ndarray:
    return np.diag(np.maximum(np.diag(tau * p @ sigma @ p.T) / confidence, floor))


def black_litterman(w: np.ndarray, sigma: np.ndarray, p: np.ndarray, q: np.ndarray, omega: np.ndarray | None = None, delta: float = 2.5, tau: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance."""
    pi = implied_returns(delta, sigma, w)
    omega = proportional_prior(sigma, tau, p) if omega is None else omega
    a = p @ (tau * sigma) @ p.T + omega
    gain = tau * sigma @ p.T @ np.linalg.pinv(a)
    return pi + gain @ (q - p @ pi), sigma + tau * sigma - gain @ p @ (tau * sigma)


def rescale_market(sims: np.ndarray, mean: float, var: float) -> np.ndarray:
    """Simulated market returns with the posterior's mean and variance."""
    return (sims - sims.mean()) / max(sims.std(), 1e-12) * math.sqrt(var) + mean


def ewma_cov(x: np.ndarray, lam: float = 0.94) -> np.ndarray:
    w = lam ** np.arange(len(x) - 1, -1, -1)
    w /= w.sum()
    d = x - w @ x
    return (d * w[:, None]).T @ d


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shrinkage of the sample covariance (ddof 0) to a scaled identity, and its intensity."""
    n, k = x.shape
    d = x - x.mean(0)
    s = d.T @ d / n
    mu = np.trace(s) / k
    d2 = ((s - mu * np.eye(k)) ** 2).sum() / k
    b2 = min((((d**2).T @ (d**2)).sum() / n - (s**2).sum()) / n / k, d2)
    rho = b2 / d2 if d2 > 0 else 0.0
    return (1 - rho) * s + rho * mu * np.eye(k), float(rho)


def oas(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Oracle-approximating shrinkage."""
    n, k = x.shape
    d = x - x.mean(0)
    s = d.T @ d / n
    mu, alpha = np.trace(s) / k, (s**2).mean()
    rho = min(1.0, (alpha + mu**2) / ((n + 1) * max(alpha - mu**2 / k, 1e-300)))
    return (1 - rho) * s + rho * mu * np.eye(k), float(rho)


def constant_correlation(s: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(s))
    r = s / np.outer(sd, sd)
    k = len(s)
    mean = (r.sum() - k) / (k * (k - 1)) if k > 1 else 0.0
    out = mean * np.outer(sd, sd)
    np.fill_diagonal(out, sd**2)
    return out


def block_correlation(r: np.ndarray, sector: np.ndarray, industry: np.ndarray, base: float) -> np.ndarray:
    """Mean correlations within industries, within sectors, and elsewhere ``base``."""
    out = np.full_like(r, base)
    for labels in (sector, industry):
        for g in np.unique(labels):
            i = np.flatnonzero(labels == g)
            if len(i) > 1:
                block = r[np.ix_(i, i)]
                out[np.ix_(i, i)] = (block.sum() - len(i)) / (len(i) * (len(i) - 1))
    np.fill_diagonal(out, 1.0)
    return out


def denoised(x: np.ndarray) -> np.ndarray:
    """Correlation eigenvalues under the Marchenko-Pastur edge averaged."""
    n, k = x.shape
    sd = x.std(0) + 1e-12
    r = np.corrcoef(x.T)
    w, v = np.linalg.eigh(r)
    noise = w <= (1 + math.sqrt(k / n)) ** 2
    w = np.where(noise, w[noise].mean() if noise.any() else 0, w)
    out = (v * w) @ v.T
    d = np.sqrt(np.diag(out))
    return out / np.outer(d, d) * np.outer(sd, sd)


def factor_cov(x: np.ndarray, f: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """B' S_f B + diag(own residual variance, blended with the mean by fit)."""
    z = np.column_stack([np.ones(len(f)), f])
    b = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ x)
    e = x - z @ b
    psi = e.var(0, ddof=min(z.shape[1], len(x) - 1))
    share = np.clip(psi / np.maximum(x.var(0), 1e-300), 0, 1)
    own = 0.3 + 0.6 * share
    return b[1:].T @ ledoit_wolf(f)[0] @ b[1:] + np.diag(own * psi + (1 - own) * psi.mean())


def simplex_box(v: np.ndarray, low: np.ndarray, high: np.ndarray, total: float = 1.0, exact: bool = True) -> np.ndarray:
    """Projection on low <= x <= high with sum total (or at most total), by bisection."""
    if not exact and np.clip(v, low, high).sum() <= total:
        return np.clip(v, low, high)
    a, z = (v - high).min() - 1, (v - low).max() + 1
    for _ in range(70):
        m = (a + z) / 2
        if np.clip(v - m, low, high).sum() > total:
            a = m
        else:
            z = m
    return np.clip(v - (a + z) / 2, low, high)


def shrinkage_cov(x: np.ndarray, targets: list[np.ndarray] | None = None, factors: np.ndarray | None = None, sector: np.ndarray | None = None, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """S + sum w (M - S): weights from 0, summing to at most 1, that bring it nearest a denoised reference; then made psd."""
    s = np.cov(x.T, ddof=0)
    ref = denoised(x)
    if targets is None:
        targets = [np.diag(np.diag(s)), constant_correlation(s), ewma_cov(x), ewma_cov(x, 0.98), oas(x)[0], ledoit_wolf(x)[0], ref]
        if factors is not None:
            targets.append(factor_cov(x, factors))
        if sector is not None:
            sd = np.sqrt(np.diag(s))
            targets.append(block_correlation(s / np.outer(sd, sd), sector, sector, 0.2) * np.outer(sd, sd))
    d = np.array([(m - s).ravel() for m in targets])
    gram, goal = d @ d.T, d @ (ref - s).ravel()
    w = np.full(len(d), 1 / (len(d) + 1))
    step = 1 / max(np.linalg.eigvalsh(gram).max(), 1e-300)
    for _ in range(steps):
        w = simplex_box(w - step * (gram @ w - goal), np.zeros(len(w)), np.ones(len(w)), 1.0, exact=False)
    return psd(s + (w @ d).reshape(s.shape)), w


def multi_frequency_cov(daily: np.ndarray, weekly: np.ndarray, monthly: np.ndarray) -> np.ndarray:
    """0.2 daily + 0.6 weekly + 0.2 monthly, annualised, in weekly units."""
    c = lambda x, n: np.cov(x.T, ddof=0) * n
    return (0.2 * c(daily, 252) + 0.6 * c(weekly, 52) + 0.2 * c(monthly, 12)) / 52


def ewma_regime_cov(x: np.ndarray, index: np.ndarray, calm: float = 0.98, stress: float = 0.94) -> np.ndarray:
    """Faster decay while the index's 5-week volatility exceeds the 90th percentile of its year."""
    vol = np.array([index[max(0, i - 4) : i + 1].std() for i in range(len(index))])
    return ewma_cov(x, stress if vol[-1] > np.quantile(vol[-52:], 0.9) else calm)


def best_lag(x: np.ndarray, f: np.ndarray, most: int = 3, ridge: float = 1e-6) -> int:
    """Lags of the factors (0 to most) with the least BIC of the joint regression, on a common sample."""
    t, k = x.shape
    best = (math.inf, 0)
    for lags in range(most + 1):
        z = np.column_stack([np.ones(t - most), *[f[most - j : t - j] for j in range(lags + 1)]])
        y = x[most:]
        e = y - z @ np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
        bic = len(y) * np.log(np.maximum(e.var(0), 1e-300)).sum() + z.shape[1] * k * math.log(len(y))
        best = min(best, (bic, lags))
    return best[1]


def orthogonal_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Each block of factors less its projection on the blocks before it."""
    out: list[np.ndarray] = []
    for b in blocks:
        out.append(b if not out else np.column_stack([residualise(b[:, j], np.column_stack(out)) for j in range(b.shape[1])]))
    return out


def factor_idio(x: np.ndarray, f: np.ndarray, keep: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Covariance explained by factors, and the rest (diagonal blended with its mean)."""
    z = np.column_stack([np.ones(len(f)), f])
    b = np.linalg.lstsq(z, x, rcond=None)[0]
    psi = (x - z @ b).var(0)
    return b[1:].T @ np.cov(f.T, ddof=0).reshape(f.shape[1], -1) @ b[1:], np.diag(keep * psi + (1 - keep) * psi.mean())


def term_scaled(factor: np.ndarray, idio: np.ndarray, weeks: int, factor_power: float = 1.0, idio_power: float = 0.9) -> np.ndarray:
    """Covariance over a horizon: the two parts grow at their own powers of time."""
    return psd(factor * weeks**factor_power + idio * weeks**idio_power)


def shrunk_correlations(x: np.ndarray, least: int = 20, alpha: float = 0.2) -> np.ndarray:
    """Pairwise correlations over the rows both have, shrunk to 0; pairs with too few are 0."""
    r = pd.DataFrame(x).corr(min_periods=least).fillna(0.0).to_numpy() * (1 - alpha)
    np.fill_diagonal(r, 1.0)
    return psd(r)


def factor_monte_carlo(panel: DataFrame, factors: list[str], horizon: int = 4, sims: int = 500, seed: int = 2, least: int = 60) -> DataFrame:
    """Per symbol: factor loadings, factor paths from a vector autoregression, own shocks; quantiles of the compounded return."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        x = x.dropna()
        if len(x) < least:
            return []
        f, y = x[factors].to_numpy(float), x["ret"].to_numpy(float)
        z = np.column_stack([np.ones(len(f)), f])
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        e = y - z @ b
        rng = G.seeded(seed, symbol)
        const, coef, cov = fit_bvar(f, 1, own=0.0)
        paths = simulate_var(const, coef, f, shocks(cov, horizon, sims, rng, "student"))
        r = b[0] + paths @ b[1:] + rng.choice(e, (sims, horizon))
        total = np.prod(1 + np.clip(r, -0.99, None), axis=1) - 1
        return [(symbol, float(total.mean()), float(total.std(ddof=1)), *map(float, np.quantile(total, [0.05, 0.5, 0.95])))]

    return G.per_symbol(panel.select("symbol", "date", "ret", *factors), "symbol", "date", "symbol {key}, mean double, sd double, p05 double, p50 double, p95 double", run)


def shrunk_factors(x: np.ndarray, steps: int = 300, floor: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shrinkage_cov`` of a panel (dates x symbols) without its square: y, a and v with covariance y a y' + diag(v).

    Every target is y a y' + diag(v) over the same features of a symbol: its returns, its deviation, its loadings on the
    eigenvectors above the Marchenko-Pastur edge. Their products come from the features' Gram matrix. Where the smallest
    eigenvalue may be under ``floor`` the diagonal is raised by it; eigenvalues aren't clipped one by one.
    """
    t, n = x.shape
    d = x - x.mean(0)
    sd = np.sqrt(np.einsum("ij,ij->j", d, d) / t)
    small, fourth, sums = d @ d.T / t, (np.einsum("ij,ij->i", d, d) ** 2).sum() / t, d @ (1 / np.maximum(sd, 1e-300))
    d /= sd + 1e-12  # one table of the panel's size at a time
    w, u = np.linalg.eigh(d @ d.T / t)
    up = w > (1 + math.sqrt(n / t)) ** 2
    lam, v = w[up], (d.T @ u[:, up]) / np.sqrt(w[up] * t)
    noise = (np.einsum("ij,ij->", d, d) / t - lam.sum()) / (n - len(lam))
    del d
    scale = (sd + 1e-12) / np.sqrt((v * v) @ (lam - noise) + noise)
    v *= scale[:, None]
    y = np.column_stack([x.T, sd, v])
    del v
    size, var = y.shape[1], sd**2
    mean, one = np.full(t, 1 / t), np.ones(n)

    def of(weights: np.ndarray) -> np.ndarray:
        a = np.zeros((size, size))
        a[:t, :t] = np.diag(weights) - np.outer(weights, weights)
        return a

    def ewm(decay: float) -> np.ndarray:
        k = decay ** np.arange(t - 1, -1, -1)
        return of(k / k.sum())

    s = of(mean)
    mu, square = var.sum() / n, (small**2).sum()
    alpha = square / n**2
    rho = min(1.0, (alpha + mu**2) / ((t + 1) * max(alpha - mu**2 / n, 1e-300)))
    d2 = (square - 2 * mu * var.sum() + n * mu * mu) / n
    b2 = min((fourth - square) / t / n, d2)
    lw = b2 / d2 if d2 > 0 else 0.0
    common = ((sums**2).sum() / t - n) / (n * (n - 1)) if n > 1 else 0.0
    flat, ref = np.zeros((size, size)), np.zeros((size, size))
    flat[t, t] = common
    ref[t + 1 :, t + 1 :] = np.diag(lam - noise)
    goal = (ref, noise * scale**2)
    targets = [(0 * s, var), (flat, (1 - common) * var), (ewm(0.94), 0 * var), (ewm(0.98), 0 * var), ((1 - rho) * s, rho * mu * one), ((1 - lw) * s, lw * mu * one), goal]
    parts = [(m - s, e) for m, e in targets]
    gram = y.T @ y
    held = [(m @ gram, np.concatenate([np.einsum("ij,ij->i", z @ m, z) for z in (y[i : i + 4096] for i in range(0, n, 4096))]), e) for m, e in parts]

    def inner(p: tuple, q: tuple) -> float:
        return float((p[0] * q[0].T).sum() + p[2] @ q[1] + q[2] @ p[1] + p[2] @ q[2])

    g = np.array([[inner(p, q) for q in held] for p in held])
    weights, step = np.full(len(held), 1 / (len(held) + 1)), 1 / max(np.linalg.eigvalsh(g).max(), 1e-300)
    for _ in range(steps):
        weights = simplex_box(weights - step * (g @ weights - g[:, -1]), np.zeros(len(held)), np.ones(len(held)), 1.0, exact=False)
    rest = sum(k * e for k, (_, e) in zip(weights, parts, strict=True))
    a = s + sum(k * m for k, (m, _) in zip(weights, parts, strict=True))
    # The parts but for a negative common correlation are positive semidefinite, so the diagonal bounds the eigenvalues below.
    low = rest.min() + (weights[1] * min(common, 0.0) * var.sum())
    return y, a, rest + max(floor - low, 0.0)


def shrunk_covariances(panel: DataFrame, most_assets: int = 2000) -> DataFrame:
    """Shrinkage covariance of a universe as long rows (a, b, cov). Up to ``most_assets`` the matrix is made at once; beyond, the panel
    is gathered as arrays (dates x assets), and tasks make blocks of rows of the matrix from its factors."""
    spark = panel.sparkSession
    kind = panel.schema["symbol"].dataType.simpleString()
    n = panel.select("symbol").distinct().count()
    if n > most_assets:
        return factored_covariances(panel)
    wide = panel.select("symbol", "date", "ret").toPandas().pivot(index="date", columns="symbol", values="ret").fillna(0.0)
    s, _ = shrinkage_cov(wide.to_numpy())
    names = wide.columns.to_numpy()
    i, j = np.triu_indices(len(names))
    return spark.createDataFrame(pd.DataFrame({"a": names[i], "b": names[j], "cov": s[i, j]}), f"a {kind}, b {kind}, cov double")


def factored_covariances(panel: DataFrame, rows: int = 256) -> DataFrame:
    """(a, b, cov), a <= b, from ``shrunk_factors``: the features are broadcast, tasks multiply ``rows`` assets by those after them."""
    spark = panel.sparkSession
    kind = panel.schema["symbol"].dataType.simpleString()
    table = M.packed(panel, label="shrunk").orderBy("s").toArrow()
    names = np.array(table["s"].to_pylist(), dtype=object)
    lists = table["rets"].combine_chunks(), table["dates"].combine_chunks()
    calendar, col = np.unique(lists[1].flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    x = np.zeros((len(calendar), len(names)))
    x[col, np.repeat(np.arange(len(names)), np.diff(lists[0].offsets.to_numpy()))] = np.nan_to_num(lists[0].flatten().to_numpy(zero_copy_only=False))
    given = spark.sparkContext.broadcast((names, *shrunk_factors(x)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, y, a, v = given.value
        for batch in batches:
            for first in batch["id"]:
                left = y[first : first + rows] @ a
                for after in range(first, len(names), 1024):
                    cov = left @ y[after : after + 1024].T
                    i, j = np.indices(cov.shape)
                    i, j = i + first, j + after
                    cov = cov + np.where(i == j, v[after : after + cov.shape[1]], 0.0)
                    keep = i <= j
                    yield pd.DataFrame({"a": names[i[keep]], "b": names[j[keep]], "cov": cov[keep]})

    blocks = -(-len(names) // rows)
    starts = spark.range(0, len(names), rows, max(1, min(blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return starts.mapInPandas(run, f"a {kind}, b {kind}, cov double")

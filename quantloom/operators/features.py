"""Inputs of forecasting models: regressor deltas and their scales, lagged designs, autoregressive baselines, jump states, index and
currency factors, scenarios, calibrated spreads and terminal growth.

All but two are SQL expressions; ``jump_intensity`` and ``terminal_growth`` see one symbol's history at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import grouped as G
from quantloom.functions import panel as P
from quantloom.functions import special as S
from quantloom.operators import forecast as X
from quantloom.operators import indicators as I

#: Levels are raised to this before their logarithm is taken.
FLOOR = 1e-6
#: Lags of the exogenous design, quantile of jumps, share of the tail, decays of the jump intensity.
LAGS = (1, 2, 3)
JUMP_QUANTILE = 0.97
TAIL_SHARE = 0.05
DECAYS = (2.0, 3.0, 4.0, 6.0, 8.0, 10.0, 12.0)
#: Index of an exchange, and of every other one.
INDEX_OF_EXCHANGE = {
    "NasdaqGS": "^NDX",
    "NasdaqGM": "^NDX",
    "NasdaqCM": "^NDX",
    "LSE": "^FTSE",
    "NYSE": "^GSPC",
    "XETRA": "^GDAXI",
    "MCE": "^IBEX",
    "Amsterdam": "^AEX",
    "Paris": "^FCHI",
    "Toronto": "^GSPTSE",
    "HKSE": "^HSI",
    "Swiss": "^SSMI",
}
OTHER_INDEX = "^GSPC"
#: Scales tried for predicted spreads, tail masses they are judged by, most a scaled spread may be.
SPREAD_SCALES = tuple(float(x) for x in np.linspace(0.6, 1.5, 20))
TAIL_MASSES = (0.10, 0.20, 0.50)
MOST_SPREAD = 10.0


def change(kind: str, x: str, w) -> Column:
    """One step of a series: ``diff`` of levels, ``dlog`` of positive levels, ``slog`` of signed ones, ``level`` as it is."""
    if kind == "level":
        return F.col(x)
    if kind == "diff":
        return P.diff(x, w)
    y = F.when(F.col(x).isNotNull(), F.log(F.greatest(F.col(x), F.lit(FLOOR)))) if kind == "dlog" else P.signed_log1p(F.col(x))
    return y - F.lag(y).over(w)


def deltas(df: DataFrame, kinds: dict[str, str], key: str = "symbol", date: str = "date") -> DataFrame:
    """Changes of regressors (name -> kind) from each symbol's second row on. NULL on either side of a step is NULL."""
    w = P.over(key, order=date)
    rows = df.select(key, date, *[change(k, c, w).alias(c) for c, k in kinds.items()], F.row_number().over(w).alias("_n"))
    return rows.filter("_n > 1").drop("_n")


def robust_scales(df: DataFrame, cols: list[str], key: str = "symbol") -> DataFrame:
    """Per symbol and column: median, interquartile range (1 where it is 0, else 1e-6 at least), 1 % and 99 % quantiles."""
    q = df.groupBy(key).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)])).alias(c) for c in cols])
    out = [F.col(key)]
    for c in cols:
        iqr = F.col(c)[3] - F.col(c)[1]
        out += [F.col(c)[2].alias(f"{c}_median"), F.when(iqr == 0, 1.0).otherwise(F.greatest(iqr, F.lit(1e-6))).alias(f"{c}_scale"), F.col(c)[0].alias(f"{c}_low"), F.col(c)[4].alias(f"{c}_high")]
    return q.select(*out)


def robustly_scaled(df: DataFrame, scales: DataFrame, cols: list[str], key: str = "symbol", most: float = 8.0) -> DataFrame:
    """Columns cut to their 1 % and 99 % quantiles, less the median, over the scale, within ``most``. A symbol without scales keeps
    its rows with NULLs."""
    rows = df.join(scales, key, "left")
    for c in cols:
        z = (P.clip(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high")) - F.col(f"{c}_median")) / F.col(f"{c}_scale")
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), P.clip(z, -most, most)))
    return rows.select(*df.columns)


def lagged_design(df: DataFrame, cols: list[str], lags: tuple[int, ...] = LAGS, period: float = 52, k: int = 2, start: int = 0, flags: tuple[str, ...] = (), key: str = "symbol", date: str = "date") -> DataFrame:
    """Lags of the regressors, flags as they are and k Fourier pairs over the row's place in its series; rows with a NULL go."""
    w = P.over(key, order=date)
    t = F.row_number().over(w) - 1 + start
    blocks = [F.lag(c, n).over(w).alias(f"{c}_L{n}") if n else F.col(c).alias(f"{c}_L0") for n in lags for c in cols]
    return df.select(key, date, *blocks, *flags, *P.fourier(t, period, k, "fourier")).na.drop()


def ar1_baselines(df: DataFrame, x: str = "ret", horizon: int = 52, key: str = "symbol", date: str = "date") -> DataFrame:
    """First-order autoregression by least squares over the known values: mean, phi, last value and the expected sum over the horizon.

    Under three values mean and phi are 0; a constant series has phi 0 and its value as the mean."""
    rows = df.filter(F.col(x).isNotNull()).select(key, date, F.col(x).alias("_y"), F.lag(x).over(P.over(key, order=date)).alias("_x"))
    pairs = F.when(F.col("_x").isNotNull(), F.col("_y"))
    fit = rows.groupBy(key).agg(F.count("_y").alias("n"), F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"), F.avg(pairs).alias("_m"), F.max_by("_y", date).alias("last"))
    few, b = F.col("n") < 3, F.coalesce("_b", F.lit(0.0))
    a = F.when(F.col("_b").isNull(), F.col("_m")).otherwise(F.col("_a"))
    fit = fit.withColumn("phi", F.when(few, 0.0).otherwise(b)).withColumn("mean", F.when(few | (F.abs(1 - b) <= 1e-8), 0.0).otherwise(a / (1 - b)))
    phi, mean = F.col("phi"), F.col("mean")
    ahead = horizon * mean + F.when(F.abs(1 - phi) < 1e-8, 0.0).otherwise((F.col("last") - mean) * phi * (1 - F.pow(phi, F.lit(float(horizon)))) / (1 - phi))
    return fit.select(key, "n", "mean", "phi", "last", ahead.alias("expected_sum"))


def jump_flags(df: DataFrame, x: str = "ret", q: float = JUMP_QUANTILE, tail: float = TAIL_SHARE, key: str = "symbol", date: str = "date") -> DataFrame:
    """Known values with their size, the jump threshold and tail cut-off of the symbol, the jump flag and the flag before it (0 at first)."""
    whole = P.whole(key)
    rows = df.filter(F.col(x).isNotNull()).select(key, date, F.col(x).alias("value"), F.abs(x).alias("size"))
    rows = rows.withColumn("threshold", F.percentile("size", F.lit(q)).over(whole)).withColumn("cutoff", F.percentile("size", F.lit(1 - tail)).over(whole))
    rows = rows.withColumn("jump", (F.col("size") >= F.col("threshold")).cast("int"))
    return rows.withColumn("before", F.lag("jump", 1, 0).over(P.over(key, order=date)))


def jump_states(flags: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    """Threshold, transition shares between calm (0) and jump (1), chance of a jump after each (within 1e-4 and 0.5; 0.01 for a state
    that never was), and the tail beyond the cut-off. The last row starts no transition; a state left never has shares of 0."""
    rows = flags.withColumn("_last", F.lead("jump").over(P.over(key, order=date)).isNull())
    move = lambda s, t: F.count(F.when(~F.col("_last") & (F.col("before") == s) & (F.col("jump") == t), 1))
    share = lambda s, t: (move(s, t) / F.greatest(move(s, 0) + move(s, 1), F.lit(1))).alias(f"p{s}{t}")
    after = lambda s: P.clip(F.coalesce(F.avg(F.when(F.col("before") == s, F.col("jump"))), F.lit(0.01)), 1e-4, 0.5).alias(f"emit{s}")
    beyond = F.when(F.col("size") >= F.col("cutoff"), F.col("size") - F.col("cutoff"))
    return rows.groupBy(key).agg(F.first("threshold").alias("threshold"), F.first("cutoff").alias("cutoff"), share(0, 0), share(0, 1), share(1, 0), share(1, 1), after(0), after(1), F.count(beyond).alias("n_tail"), F.avg(beyond).alias("mean_excess"))


def _logit(h: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[float, float, float]:
    """Logistic regression of y on one regressor with a slope of 0 at least, by Newton steps: intercept, slope, negative log likelihood."""
    p0 = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    flat = math.log(p0 / (1 - p0))
    cost = lambda b: float((np.logaddexp(0, b[0] + b[1] * h) - y * (b[0] + b[1] * h)).sum())
    b = np.array([flat, 0.0])
    x = np.column_stack([np.ones_like(h), h])
    for _ in range(steps):
        p = (1 + np.tanh(x @ b / 2)) / 2
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (y - p))
        size = 1.0
        while size > 1e-6 and cost(b + size * step) > cost(b) + 1e-12:
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-10:
            break
    b = b if b[1] > 0 else np.array([flat, 0.0])
    return float(b[0]), float(b[1]), cost(b)


def jump_excitation(jumps: np.ndarray, decays: tuple[float, ...] = DECAYS, most: float = 1.0) -> tuple[float, float]:
    """Self-excitation of jumps: strength (``most`` at most) and decay of the likeliest logistic intensity over decayed past jumps.
    Under 20 values, or with next to no jumps, strength 0 and the first decay."""
    y = np.asarray(jumps, float)
    if len(y) < 20 or y.mean() < 1e-4:
        return 0.0, float(decays[0])
    best = None
    for d in decays:
        h, keep = np.zeros(len(y)), math.exp(-d)
        for t in range(1, len(y)):
            h[t] = keep * h[t - 1] + y[t - 1]
        _, slope, cost = _logit(h, y)
        if best is None or cost < best[0] - 1e-9:
            best = (cost, slope, d)
    return min(best[1], most), float(best[2])


def jump_intensity(flags: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    """Excitation of the jumps and a Pareto tail of the sizes (probability-weighted moments; shape 0.2 and half the sizes' deviation
    where fewer than 20 values lie in the tail)."""

    def run(k, x: pd.DataFrame):
        size, cut = x["size"].to_numpy(float), float(x["cutoff"].iloc[0])
        strength, decay = jump_excitation(x["jump"].to_numpy())
        tail = X.gpd_tail(-size, 1 - TAIL_SHARE, 20) if (size >= cut).sum() >= 20 else None
        shape, scale = tail[1:] if tail else (0.2, max(float(size.std()) * 0.5, 1e-6))
        return [(k, strength, decay, shape, max(scale, 1e-6))]

    return G.per_symbol(flags.select(key, date, "size", "cutoff", "jump"), key, date, f"{key} {{key}}, strength double, decay double, shape double, scale double", run)


def looks_like_returns(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """Whether over 90 % of a series' values lie within 0.5 and over 99 % within 2; a series without values counts as returns."""
    share = lambda m: F.avg((F.abs(x) <= m).cast("double"))
    return df.groupBy(key).agg(F.count(x).alias("n"), F.coalesce((share(0.5) > 0.9) & (share(2.0) > 0.99), F.lit(True)).alias("is_returns"))


def index_panel(levels: DataFrame, key: str = "symbol", date: str = "date", x: str = "close") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weekly and quarterly returns of indexes with gaps filled, and each one's (last / first) ^ 0.2 - 1."""
    w = P.over(key, order=date)
    rows = levels.withColumn(x, F.coalesce(P.ffill(x, w), P.bfill(x, w)))
    by = lambda rule: P.resample(rows, rule, {x: "last"}, key, date).select(key, date, P.pct_change(x, w).alias("ret")).filter("ret IS NOT NULL")
    ends = rows.groupBy(key).agg((F.pow(P.ratio(F.max_by(x, date), F.min_by(x, date)), F.lit(0.2)) - 1).alias("ann_return"))
    return by("W-SUN"), by("QE"), ends


def index_of(exchange: Column) -> Column:
    """Index of an exchange, the default for others and NULL."""
    table = F.create_map(*[F.lit(v) for pair in INDEX_OF_EXCHANGE.items() for v in pair])
    return F.coalesce(F.try_element_at(table, exchange), F.lit(OTHER_INDEX))


def matched_index(listed: DataFrame, returns: DataFrame, override: DataFrame | None = None, key: str = "symbol") -> DataFrame:
    """listed (symbol, exchange) with its index and that index's return: the override's, else its own, else 0. returns and override:
    (index, ann_return), a handful of rows."""
    rows = listed.withColumn("index", index_of(F.col("exchange"))).join(returns.select("index", F.col("ann_return").alias("_own")), "index", "left")
    known = [F.col("_own"), F.lit(0.0)]
    if override is not None:
        rows = rows.join(override.select("index", F.col("ann_return").alias("_over")), "index", "left")
        known.insert(0, F.col("_over"))
    return rows.select(key, "exchange", "index", F.coalesce(*known).alias("index_return"))


def currency_factors(rates: DataFrame, currencies: list[str], base: str) -> DataFrame:
    """Weekly returns of rates (ccy, date, rate) as one column FX_<ccy> for each currency but the base."""
    weeks = P.resample(rates, "W-SUN", {"rate": "last"}, "ccy")
    r = weeks.select("ccy", "date", P.pct_change("rate", P.over("ccy")).alias("ret"))
    wanted = [c for c in currencies if c != base]
    wide = r.groupBy("date").pivot("ccy", wanted).agg(F.first("ret"))
    return wide.select("date", *[F.col(f"`{c}`").alias(f"FX_{c}") for c in wanted])


def external_alpha(expected: DataFrame, betas: DataFrame, market: float, risk_free: float = 0.0, excess: bool = True, fallback: float = 1.0, key: str = "symbol") -> DataFrame:
    """Expected return less what a beta from elsewhere explains; total returns also give up (1 - beta) of the riskless rate. Symbols
    without a beta take the fallback."""
    rows = expected.join(betas.select(key, F.col("beta").alias("_b")), key, "left").withColumn("beta", F.coalesce("_b", F.lit(fallback)))
    alpha = F.col("expected") - F.col("beta") * market
    return rows.select(key, "expected", "beta", (alpha if excess else alpha - (1 - F.col("beta")) * risk_free).alias("alpha"))


def working_capital_slopes(df: DataFrame, revenue: str = "revenue", working: str = "working_capital", key: str = "symbol", date: str = "date") -> DataFrame:
    """Median step of working capital over the step of revenue, within 0.4 of zero; NULL under four rows that have both, or where
    revenue never moves."""
    w = P.over(key, order=date)
    rows = df.filter(F.col(revenue).isNotNull() & F.col(working).isNotNull()).select(key, P.ratio(P.diff(working, w), P.diff(revenue, w)).alias("_s"))
    slope = P.clip(F.percentile("_s", F.lit(0.5)), -0.4, 0.4)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), slope.alias("slope")).withColumn("slope", F.when(F.col("n") >= 4, F.col("slope")))


def count_z(n: Column) -> Column:
    """Normal quantile at 1 - 1/n of a count of analysts; counts up to 2 are taken for 3."""
    m = F.when(n <= 2, 3.0).otherwise(n.cast("double"))
    return S.ppf(1 - 1 / m)


def scenario_rows(df: DataFrame, revenue: dict[str, str], eps: dict[str, str], key: str = "symbol") -> DataFrame:
    """Every pair of a revenue and an earnings scenario (label -> column) of a symbol, with the rest of its row repeated."""
    sets = lambda s: F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).cast("double").alias("value")) for k, c in s.items()]))
    used = set(revenue.values()) | set(eps.values())
    rest = [c for c in df.columns if c != key and c not in used]
    rows = df.withColumn("_r", sets(revenue)).withColumn("_e", sets(eps))
    name = F.concat("_r.label", F.lit("_rev__"), "_e.label", F.lit("_eps"))
    return rows.select(key, name.alias("scenario"), F.col("_r.value").alias("revenue_growth"), F.col("_e.value").alias("eps_growth"), *rest)


def aligned_to_training(df: DataFrame, train: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """The training columns in order: those the rows lack, or hold NULL in, take the training median (one row for all)."""
    medians = train.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in cols])
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) if c in df.columns else F.col(f"_m_{c}")
    return df.crossJoin(F.broadcast(medians)).select(*keep, *[at(c).alias(c) for c in cols])


def prices_of_returns(df: DataFrame, last: DataFrame, r: str = "log_ret", key: str = "symbol", date: str = "date") -> DataFrame:
    """Forecast log returns compounded from each symbol's last price; a missing return moves nothing."""
    path = P.cumsum(F.coalesce(F.col(r), F.lit(0.0)), P.over(key, order=date))
    return df.join(last.select(key, F.col("price").alias("_p")), key).withColumn("price", F.col("_p") * F.exp(path)).drop("_p")


def t_quantile(p: float, dof: float | None) -> float:
    """Student's quantile by bisection of its tail, the normal one without degrees of freedom."""
    if dof is None:
        return S.norm_ppf(p)
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if S.t_sf(mid, dof) > 1 - p else (low, mid)
    return (low + high) / 2


def spread_scales(df: DataFrame, y: str, mu: str, sigma: str, dof: float | None = None, key: str = "symbol") -> DataFrame:
    """Per symbol the factor on predicted spreads whose central intervals cover held-out values nearest to what they should: least
    mean squared error over the tail masses, the smallest factor of equals. One aggregate, no row is repeated."""
    known = F.col(y).isNotNull() & F.col(mu).isNotNull() & F.col(sigma).isNotNull()
    miss = F.abs(F.col(y) - F.col(mu))
    inside = lambda s, a: F.avg((miss <= F.least(F.lit(MOST_SPREAD), F.col(sigma) * s) * t_quantile(1 - a / 2, dof)).cast("double")) - (1 - a)
    tried = []
    for s in SPREAD_SCALES:
        errors = [inside(s, a) for a in TAIL_MASSES]
        tried.append(F.struct((sum((e * e for e in errors), F.lit(0.0)) / len(errors)).alias("loss"), F.lit(s).alias("scale")))
    return df.filter(known).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.least(*tried).alias("_t")).select(key, "n", "_t.scale", "_t.loss")


def live_levels(rows: DataFrame) -> DataFrame:
    """Over the columns of ``indicators.precompute``: each rule's level, and whether its entry condition holds on that bar."""
    c, lag = F.col("close"), lambda x: F.lag(x).over(I.W())
    z = P.ratio(c - F.col("bb_mid"), F.col("bb_std"))
    ema, macd, vwap = F.col("ema_fast") - F.col("ema_slow"), F.col("macd") - F.col("macd_signal"), c - F.col("vwap")
    reach = I.ATR_MULT * lag("atr")
    diverging = ((c < F.col("close_lo_prev")) & (F.col("obv") >= F.col("obv_lo_prev"))) | ((c > F.col("close_hi_prev")) & (F.col("obv") <= F.col("obv_hi_prev")))
    outside = lambda x, low, high: (F.col(x) < low) | (F.col(x) > high)
    rules = {
        "rsi": (F.col("rsi"), outside("rsi", I.RSI_LOW, I.RSI_HIGH)),
        "mfi": (F.col("mfi"), outside("mfi", I.MFI_LOW, I.MFI_HIGH)),
        "bb": (z, F.abs(z) >= I.BB_STD),
        "atr": (F.col("atr"), (c > F.col("hi_prev") + reach) | (c < F.col("lo_prev") - reach)),
        "stoch": (F.col("stoch_k"), outside("stoch_k", I.STOCH_LOW, I.STOCH_HIGH)),
        "ema": (ema, ema != 0),
        "macd": (macd, macd != 0),
        "vwap": (vwap, vwap != 0),
        "obv": (F.col("obv"), diverging),
    }
    live = [F.struct(F.lit(n).alias("indicator"), v.cast("double").alias("value"), F.coalesce(on, F.lit(False)).alias("live")) for n, (v, on) in rules.items()]
    return rows.select("symbol", "date", F.array(*live).alias("_l")).select("symbol", "date", F.inline("_l"))


def last_levels(levels: DataFrame) -> DataFrame:
    """Each rule's last known level, whether it was live there, and on how many bars it ever was."""
    known = F.when(P.clean("value").isNotNull(), F.col("date"))
    return levels.groupBy("symbol", "indicator").agg(F.max_by("value", known).alias("value"), F.max_by("live", known).alias("live"), F.count_if("live").alias("n_live"))


def pert_mode(low: Column, mode: Column, high: Column) -> Column:
    """A mode strictly within its bounds: itself, or 1e-8 inside the bound it passed."""
    return F.when((low < mode) & (mode < high), mode).otherwise(P.clip(mode, low + 1e-8, high - 1e-8))


def growth_draws(roe: np.ndarray | None, payout: np.ndarray | None, rng: np.random.Generator, n: int, bounds: tuple[float, float, float] = (0.0, 0.02, 0.04), lam: float = 6.0, span: int = 40) -> np.ndarray:
    """Terminal growth: what is retained of returns on equity drawn about their exponential mean (truncated to +-1; 0.10 +- 0.05 for an
    empty history), or without a history or payouts a PERT within bounds. All within +-1."""
    if roe is None or payout is None:
        return np.clip(X.pert(*bounds, n, rng, lam), -1, 1)
    mu, sd = 0.10, 0.05
    if len(roe):
        a = G.alpha_of(span=span)
        mu, s = float(G.ewm_mean(roe, a)[-1]), float(G.ewm_std(roe, a)[-1])
        sd = max(0.02, 0.10 * abs(mu), s if math.isfinite(s) else 0.0)
    return np.clip((1 - np.clip(payout, 0, 10)) * X.truncated_normal(mu, sd, -1.0, 1.0, n, rng), -1, 1)


def terminal_growth(history: DataFrame, payouts: DataFrame, sims: int = 2000, seed: int = 7, key: str = "symbol", date: str = "date") -> DataFrame:
    """Mean, deviation and 5, 50 and 95 % quantiles of simulated terminal growth. history: (symbol, date, roe); payouts: (symbol, payout,
    payout_sd). A symbol without payout draws from the default bounds."""

    def run(k, x: pd.DataFrame):
        rng = G.seeded(seed, k)
        roe, pay, sd = x["roe"].dropna().to_numpy(float), x["payout"].iloc[0], x["payout_sd"].iloc[0]
        draws = None if pd.isna(pay) else rng.normal(float(pay), 0.0 if pd.isna(sd) else float(sd), sims)
        g = growth_draws(roe, draws, rng, sims)
        return [(k, len(roe), float(g.mean()), float(g.std(ddof=1)), *np.quantile(g, (0.05, 0.5, 0.95)).tolist())]

    rows = history.select(key, date, "roe").join(payouts.select(key, "payout", "payout_sd"), key, "left")
    return G.per_symbol(rows, key, date, f"{key} {{key}}, n int, mean double, sd double, p05 double, p50 double, p95 double", run)

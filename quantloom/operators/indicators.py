"""Technical indicators, trading rules, positions and scores (``calibration`` searches the rules' parameters).

All frames of one symbol share one sort (partition symbol, order date), so a wide select stays one Window stage. Only
exponential recurrences and cooldowns run as grouped kernels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions import grouped as G
from quantloom.functions import panel as P
from quantloom.functions import special as S

#: Default windows and thresholds of the rules.
ADX_WINDOW, ADX_ENTRY, VOLUME_WINDOW = 14, 25.0, 20
RSI_WINDOW, RSI_LOW, RSI_HIGH = 14, 30.0, 70.0
BB_WINDOW, BB_STD = 20, 2.0
ATR_WINDOW, ATR_BREAK, ATR_MULT = 14, 20, 1.5
STOCH_K, STOCH_D, STOCH_LOW, STOCH_HIGH = 14, 3, 20.0, 80.0
EMA_FAST, EMA_SLOW, MACD_SIGNAL = 12, 26, 9
MFI_WINDOW, MFI_LOW, MFI_HIGH = 14, 20.0, 80.0
OBV_WINDOW, VWAP_WINDOW = 20, 20
NAMES = ("macd", "ema", "atr", "rsi", "bb", "stoch", "obv", "mfi", "vwap")
def W():
    """Each symbol in date order."""
    return P.over("symbol")



def align(bars: DataFrame) -> DataFrame:
    """One row per (symbol, date), the last one given, with all of high, low, close and volume present."""
    rows = bars.dropna(subset=["high", "low", "close", "volume"])
    order = [F.col("seq")] if "seq" in bars.columns else [F.struct("close", "high", "low", "volume")]
    return P.keep_last(rows, ["symbol", "date"], order)


def true_range() -> Column:
    prev = F.lag("close").over(W())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(bars: DataFrame, n: int = ATR_WINDOW) -> DataFrame:
    return bars.withColumn("tr", true_range()).withColumn("atr", P.rolling(F.avg, "tr", W(), n))


def bollinger(bars: DataFrame, n: int = BB_WINDOW, k: float = BB_STD) -> DataFrame:
    mid, sd = P.rolling(F.avg, "close", W(), n), P.rolling(F.stddev_pop, "close", W(), n)
    return bars.withColumn("bb_mid", mid).withColumn("bb_std", sd).withColumn("bb_low", F.col("bb_mid") - k * F.col("bb_std")).withColumn("bb_high", F.col("bb_mid") + k * F.col("bb_std"))


def stochastic(bars: DataFrame, k: int = STOCH_K, d: int = STOCH_D) -> DataFrame:
    low, high = P.rolling(F.min, "low", W(), k), P.rolling(F.max, "high", W(), k)
    rows = bars.withColumn("stoch_k", 100 * P.ratio(F.col("close") - low, high - low))
    return rows.withColumn("stoch_d", P.rolling(F.avg, "stoch_k", W(), d))


def obv(bars: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(P.diff("close", W())), F.lit(0.0)) * F.col("volume")
    return bars.withColumn("_s", step).withColumn("obv", P.cumsum(F.col("_s"), W())).drop("_s")


def mfi(bars: DataFrame, n: int = MFI_WINDOW) -> DataFrame:
    rows = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    step = P.diff("_tp", W())
    flow = F.col("_tp") * F.col("volume")
    rows = rows.withColumn("_up", F.when(step > 0, flow).otherwise(0.0)).withColumn("_dn", F.when(step < 0, flow).otherwise(0.0))
    part = P.ratio(P.rolling(F.sum, "_up", W(), n), P.rolling(F.sum, "_dn", W(), n))
    return rows.withColumn("mfi", 100 - 100 / (1 + part)).drop("_tp", "_up", "_dn")


def vwap(bars: DataFrame, n: int = VWAP_WINDOW) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = bars.withColumn("_pv", F.coalesce(tp * F.col("volume"), F.lit(0.0))).withColumn("_v", F.coalesce("volume", F.lit(0.0)))
    return rows.withColumn("vwap", P.ratio(P.rolling(F.sum, "_pv", W(), n), P.rolling(F.sum, "_v", W(), n))).drop("_pv", "_v")


def breakouts(bars: DataFrame, n: int = ATR_BREAK) -> DataFrame:
    """Extremes of the n bars before this one."""
    rows = bars.withColumn("hi_prev", P.rolling(F.max, "high", W(), n, shift=1)).withColumn("lo_prev", P.rolling(F.min, "low", W(), n, shift=1))
    rows = rows.withColumn("close_hi_prev", P.rolling(F.max, "close", W(), n, shift=1)).withColumn("close_lo_prev", P.rolling(F.min, "close", W(), n, shift=1))
    if "obv" in bars.columns:
        rows = rows.withColumn("obv_hi_prev", P.rolling(F.max, "obv", W(), n, shift=1)).withColumn("obv_lo_prev", P.rolling(F.min, "obv", W(), n, shift=1))
    return rows


def volume_ok(n: int = VOLUME_WINDOW) -> Column:
    return F.coalesce(F.col("volume") >= P.rolling(lambda x: F.percentile(x, F.lit(0.5)), "volume", W(), n), F.lit(False))


def _rsi(close: np.ndarray, n: int) -> np.ndarray:
    step = np.diff(close, prepend=np.nan)
    up, dn = np.where(step > 0, step, 0.0), np.where(step < 0, -step, 0.0)
    a = 1 / n
    gain, loss = G.ewm_mean(up, a), G.ewm_mean(dn, a)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
    out[: n - 1] = np.nan
    return out


def _adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    prev = np.roll(close, 1)
    prev[:1] = np.nan
    tr = np.fmax(high - low, np.fmax(np.abs(high - prev), np.abs(low - prev)))
    a = 1 / n
    mean = G.ewm_mean(tr, a)
    mean[mean == 0] = np.nan
    up, dn = np.maximum(np.diff(high, prepend=np.nan), 0), np.maximum(-np.diff(low, prepend=np.nan), 0)
    plus, minus = np.where(up > dn, up, 0.0), np.where(dn > up, dn, 0.0)
    di_p, di_m = 100 / mean * G.ewm_mean(plus, a), 100 / mean * G.ewm_mean(minus, a)
    total = di_p + di_m
    total[total == 0] = np.nan
    return G.ewm_mean(100 * np.abs(di_p - di_m) / total, a)


def exponential(bars: DataFrame, rsi: int = RSI_WINDOW, fast: int = EMA_FAST, slow: int = EMA_SLOW, signal: int = MACD_SIGNAL, adx: int = ADX_WINDOW) -> DataFrame:
    """EMA, MACD, RSI and ADX: one grouped kernel over each symbol's bars."""

    def run(x: pd.DataFrame) -> dict[str, np.ndarray]:
        c = x["close"].to_numpy(float)
        f, s = G.ewm_mean(c, G.alpha_of(span=fast)), G.ewm_mean(c, G.alpha_of(span=slow))
        return {"ema_fast": f, "ema_slow": s, "macd": f - s, "macd_signal": G.ewm_mean(f - s, G.alpha_of(span=signal)), "rsi": _rsi(c, rsi), "adx": _adx(x["high"].to_numpy(float), x["low"].to_numpy(float), c, adx)}

    cols = {c: "double" for c in ("ema_fast", "ema_slow", "macd", "macd_signal", "rsi", "adx")}
    out = G.per_group(bars, "symbol", "date", cols, run)
    return out.select(*bars.columns, *[P.clean(c).alias(c) for c in cols])


def precompute(bars: DataFrame) -> DataFrame:
    """Every input of the rules, with the trend mask (ADX) and the volume gate."""
    rows = exponential(bars)
    rows = rows.withColumn("ret", P.pct_change("close", W())).withColumn("vol_ok", volume_ok()).withColumn("trend", F.coalesce(F.col("adx") >= ADX_ENTRY, F.lit(False)))
    return breakouts(vwap(mfi(obv(stochastic(bollinger(atr(rows)))))), ATR_BREAK)


def rules() -> dict[str, tuple[Column, Column]]:
    """(buy, sell) of each indicator over the columns of ``precompute``, gates applied. NULL comparisons are false."""
    lag = lambda c: F.lag(c).over(W())
    c, c1 = F.col("close"), lag("close")
    up = lambda x, y: P.crosses_over(x, y, W())
    down = lambda x, y: P.crosses_under(x, y, W())
    rise = lambda x, y, x1: (x > y) & (x1 <= y)
    fall = lambda x, y, x1: (x < y) & (x1 >= y)
    atr1 = ATR_MULT * lag("atr")
    raw = {
        "macd": (up("macd", "macd_signal"), down("macd", "macd_signal"), "trend", True),
        "ema": (up("ema_fast", "ema_slow"), down("ema_fast", "ema_slow"), "trend", True),
        "atr": (c > F.col("hi_prev") + atr1, c < F.col("lo_prev") - atr1, "trend", True),
        "rsi": (rise(F.col("rsi"), F.lit(RSI_LOW), lag("rsi")), fall(F.col("rsi"), F.lit(RSI_HIGH), lag("rsi")), "calm", False),
        "bb": (rise(c, F.col("bb_low"), c1), fall(c, F.col("bb_high"), c1), "calm", False),
        "stoch": ((F.col("stoch_k") < STOCH_LOW) & up("stoch_k", "stoch_d"), (F.col("stoch_k") > STOCH_HIGH) & down("stoch_k", "stoch_d"), "calm", False),
        "obv": ((c < F.col("close_lo_prev")) & (F.col("obv") >= F.col("obv_lo_prev")), (c > F.col("close_hi_prev")) & (F.col("obv") <= F.col("obv_hi_prev")), "trend", True),
        "mfi": (rise(F.col("mfi"), F.lit(MFI_LOW), lag("mfi")), fall(F.col("mfi"), F.lit(MFI_HIGH), lag("mfi")), None, False),
        "vwap": (rise(c, F.col("vwap"), c1), fall(c, F.col("vwap"), c1), "trend", True),
    }
    out = {}
    for name, (buy, sell, trend, volume) in raw.items():
        gate = F.lit(True)
        if trend:
            gate = gate & (F.col("trend") if trend == "trend" else ~F.col("trend"))
        if volume:
            gate = gate & F.col("vol_ok")
        out[name] = tuple(F.coalesce(x & gate, F.lit(False)) for x in (buy, sell))
    return out


def held(buy: Column, sell: Column, mode: str = "sell_wins") -> Column:
    """Position without cooldown: the last pulse, 0 before any."""
    both = {"sell_wins": F.lit(-1), "buy_wins": F.lit(1), "mutual": F.lit(None).cast("int")}[mode]
    pulse = F.when(buy & sell, both).when(buy, 1).when(sell, -1)
    return F.coalesce(F.last(pulse, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int")


def with_cooldown(signals: DataFrame, buy: str, sell: str, out: str = "position", lag: int = 0, cooldown: int = 0, mode: str = "sell_wins") -> DataFrame:
    return G.per_group(signals, "symbol", "date", {out: "int"}, lambda x: {out: G.positions(x[buy].to_numpy(bool), x[sell].to_numpy(bool), lag, cooldown, mode)})


def positions(pre: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """pos_<name> for each rule: pulses first, then the held position, in two Window stages."""
    r = rules()
    rows = pre.select("*", *[x.alias(f"_{side}_{n}") for n in names for side, x in zip(("b", "s"), r[n], strict=True)])
    rows = rows.select(*pre.columns, *[held(F.col(f"_b_{n}"), F.col(f"_s_{n}")).alias(f"pos_{n}") for n in names])
    return rows


def score(pos: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of positions, clipped to -10 .. 10."""
    weights = weights or dict.fromkeys(NAMES, 1.0)
    total = sum((F.lit(float(weights.get(n, 0))) * F.col(f"pos_{n}") for n in NAMES if f"pos_{n}" in pos.columns), F.lit(0.0))
    return pos.withColumn("score", F.least(F.greatest(F.round(total), F.lit(-10.0)), F.lit(10.0)).cast("short"))


def stats(pos: DataFrame, position: str, keys: list[str], annual: float = 252.0) -> DataFrame:
    """Of yesterday's position times today's return: n, mean, Sharpe, t and one-sided p of a Student t."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = pos.withColumn("_p", F.lag(position).over(w)).filter("_p IS NOT NULL AND ret IS NOT NULL").withColumn("_r", F.col("_p") * F.col("ret"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("sd"), (F.sqrt(F.lit(annual)) * P.ratio(F.avg(F.log1p("ret")), F.stddev_samp(F.log1p("ret")))).alias("sharpe_bh"))
    ok = F.col("sd") > 0
    out = out.withColumn("sharpe", F.when(ok, F.sqrt(F.lit(annual)) * F.col("mean") / F.col("sd"))).withColumn("t_stat", F.when(ok, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0))
    return out.withColumn("p_value", t_tail(F.greatest("t_stat", F.lit(0.0)), F.greatest(F.col("n") - 1, F.lit(1))))


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([S.t_sf(a, float(b)) for a, b in zip(t, df, strict=True)], dtype=float)


def weight(alpha: float = 0.05, least: float = 0.0) -> Column:
    """0 unless significant and better than buy and hold; else 1 to 4 by the improvement."""
    gain = F.col("sharpe") - F.coalesce("sharpe_bh", F.lit(0.0))
    bad = F.col("sharpe").isNull() | (F.col("p_value") >= alpha) | (F.col("sharpe") < least) | (gain <= 0)
    return F.when(bad, 0).when(gain >= 1.0, 4).when(gain >= 0.5, 3).when(gain >= 0.25, 2).otherwise(1)


def liquidity(bars: DataFrame, window: int = 20, least: float = 0.6) -> DataFrame:
    """Average dollar volume over the last ``window`` bars, on each symbol's last bar."""
    rows = bars.withColumn("_v", F.col("close") * F.col("volume")).withColumn("adv", P.rolling(F.avg, "_v", W(), window, int(least * window)))
    return rows.groupBy("symbol").agg(F.max_by("adv", "date").alias("adv"))


def amihud(bars: DataFrame, window: int = 60, least: float = 0.6) -> DataFrame:
    """Mean absolute return per dollar volume on the last bar; symbols without take the median."""
    rows = bars.withColumn("_x", P.ratio(F.abs(P.pct_change("close", W())), F.col("close") * F.col("volume"))).withColumn("amihud", P.rolling(F.avg, "_x", W(), window, int(least * window)))
    one = rows.groupBy("symbol").agg(F.max_by("amihud", "date").alias("amihud"))
    mid = one.agg(F.percentile("amihud", F.lit(0.5)).alias("_m"))  # one row
    return one.crossJoin(F.broadcast(mid)).select("symbol", F.coalesce("amihud", "_m").alias("amihud"))


def realised(bars: DataFrame, n: int = 20) -> DataFrame:
    """Rolling deviation, quarticity and bipower variation of log returns."""
    rows = bars.withColumn("lr", P.log_return("close", W())).withColumn("_b", F.abs("lr") * F.abs(F.lag("lr").over(W())))
    return rows.select("symbol", "date", P.rolling(F.stddev_samp, "lr", W(), n).alias("rv"), P.rolling(F.sum, F.pow("lr", F.lit(4)), W(), n).alias("rq"), P.rolling(F.sum, "_b", W(), n).alias("bpv"))


def jumps(returns: DataFrame, q: float = 0.95) -> DataFrame:
    """1 where the absolute return exceeds its symbol's q-quantile."""
    cut = returns.groupBy("symbol").agg(F.percentile(F.abs("ret"), F.lit(q)).alias("cut"))
    return returns.join(cut, "symbol").withColumn("jump", F.coalesce((F.abs("ret") > F.col("cut")).cast("int"), F.lit(0)))


def autocorrelation(returns: DataFrame, k: int = 1) -> DataFrame:
    rows = returns.withColumn("_l", F.lag("ret", k).over(W()))
    return rows.groupBy("symbol").agg(F.corr("ret", "_l").alias("rho"))


def calibration_map(rows: DataFrame) -> DataFrame:
    """JSON parameters of stored calibrations as maps."""
    return rows.withColumn("params", F.from_json("param_json", "map<string,double>"))


def calibrated_score(pos: DataFrame, calibration: DataFrame) -> DataFrame:
    """Scores with each symbol's own weights: sum of weight x position, clipped."""
    w = calibration.groupBy("symbol").pivot("indicator", list(NAMES)).agg(F.first("weight"))
    rows = pos.join(w.select("symbol", *[F.col(n).alias(f"_w_{n}") for n in NAMES]), "symbol", "left")
    total = sum((F.coalesce(F.col(f"_w_{n}"), F.lit(0)) * F.col(f"pos_{n}") for n in NAMES), F.lit(0))
    return rows.withColumn("score", F.least(F.greatest(total, F.lit(-10)), F.lit(10)).cast("short")).drop(*[f"_w_{n}" for n in NAMES])

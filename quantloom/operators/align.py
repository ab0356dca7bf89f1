"""Cleaning and time alignment: unit repair, calendar ends, currency conversion, macro alignment, outliers, forecasts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import grouped as G
from quantloom.functions import panel as P
from quantloom.operators import joins as J

#: Currency of an exchange suffix.
SUFFIX_CCY = {".L": "GBP", ".PA": "EUR", ".AS": "EUR", ".DE": "EUR", ".MI": "EUR", ".MC": "EUR", ".BR": "EUR", ".SW": "CHF", ".T": "JPY", ".HK": "HKD", ".TO": "CAD", ".AX": "AUD"}
#: Dividers of an annual rate.
PERIODS = {"daily": 252, "weekly": 52, "quarterly": 4}


def repair_unit_flips(prices: DataFrame, col: str = "close", factor: float = 100.0, jump: float = 20.0) -> DataFrame:
    """Series that flip between a unit and its hundredth, repaired bar by bar against the last repaired value."""
    schema = prices.schema
    fixed = G.per_group(prices, "symbol", "date", {"_fixed": "double"}, lambda x: {"_fixed": G.repair_unit_flips(x[col].to_numpy(float), factor, jump)})
    return fixed.withColumn(col, P.clean("_fixed")).select(*schema.names)


def close_series(prices: DataFrame, pence: Column) -> DataFrame:
    """Repaired, pence to pounds, gaps interpolated."""
    rows = repair_unit_flips(prices).withColumn("close", F.when(pence, F.col("close") / 100).otherwise(F.col("close")))
    return P.interpolate(rows, "close")


def end_at(df: DataFrame, today: Column, values: list[str], returns: bool = False, key: str = "symbol") -> DataFrame:
    """Cuts rows after today and adds one at today: returns 0, levels carried."""
    rows = df.filter(F.col("date") <= today)
    last = rows.groupBy(key).agg(F.max("date").alias("_d"), *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("date"))).alias(v) for v in values])
    add = last.filter(F.col("_d") < today).select(key, today.alias("date"), *[(F.lit(0.0) if returns else F.col(v)).alias(v) for v in values])
    return rows.select(key, "date", *values).unionByName(add)


def clip_outliers(df: DataFrame, cols: list[str], by: list[str], k: float = 1.5) -> DataFrame:
    """Tukey fences within groups; values beyond are moved to the fence."""
    w = Window.partitionBy(*by)
    out = df
    for c in cols:
        q1, q3 = (F.percentile(c, F.lit(q)).over(w) for q in (0.25, 0.75))
        out = out.withColumn(c, P.clip(F.col(c), q1 - k * (q3 - q1), q3 + k * (q3 - q1)))
    return out


def drop_outliers(df: DataFrame, c: str, by: list[str], k: float = 1.5) -> DataFrame:
    w = Window.partitionBy(*by)
    q1, q3 = (F.percentile(c, F.lit(q)).over(w) for q in (0.25, 0.75))
    rows = df.withColumn("_ok", F.col(c).between(q1 - k * (q3 - q1), q3 + k * (q3 - q1)))
    return rows.filter("_ok").drop("_ok")


def winsorize(df: DataFrame, c: str, p: float, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(c, P.clip(F.col(c), F.percentile(c, F.lit(p)).over(w), F.percentile(c, F.lit(1 - p)).over(w)))


def mad_clip(df: DataFrame, c: str, by: list[str], z: float = 8.0) -> DataFrame:
    """Median +- z robust deviations."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_m", F.percentile(c, F.lit(0.5)).over(w)).withColumn("_a", F.abs(F.col(c) - F.col("_m")))
    s = 1.4826 * F.percentile("_a", F.lit(0.5)).over(w)
    return rows.withColumn("_s", s).withColumn(c, P.clip(F.col(c), F.col("_m") - z * F.col("_s"), F.col("_m") + z * F.col("_s"))).drop("_m", "_a", "_s")


def robust_scale(df: DataFrame, c: str, by: list[str], out: str, p: float = 0.05, coverage: float = 0.6) -> DataFrame:
    """Cross-section: winsorised at p, (x - median) / (1.4826 MAD), deviation where MAD is 0, 0 where that is; NULL under the
    coverage of non-null values."""
    w = Window.partitionBy(*by)
    rows = winsorize(df.withColumn(out, F.col(c)), out, p, by)
    rows = rows.withColumn("_m", F.percentile(out, F.lit(0.5)).over(w)).withColumn("_a", F.abs(F.col(out) - F.col("_m")))
    rows = rows.withColumn("_mad", 1.4826 * F.percentile("_a", F.lit(0.5)).over(w)).withColumn("_sd", F.stddev_samp(out).over(w)).withColumn("_cov", F.count(out).over(w) / F.count(F.lit(1)).over(w))
    s = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.col("_sd"))
    z = F.when(s > 0, (F.col(out) - F.col("_m")) / s).otherwise(F.lit(0.0))
    return rows.withColumn(out, F.when((F.col("_cov") >= coverage) & F.col(out).isNotNull(), z)).drop("_m", "_a", "_mad", "_sd", "_cov")


def suffix_currency(symbol: Column, default: str = "USD") -> Column:
    suffix = F.regexp_extract(symbol, r"(\.[A-Z]+)$", 1)
    out = F.lit(default)
    for k, v in SUFFIX_CCY.items():
        out = F.when(suffix == k, F.lit(v)).otherwise(out)
    return out


def usd_per_ccy(quotes: DataFrame) -> DataFrame:
    """(ccy, date, usd_per) on weekdays: direct quotes (CCYUSD) first, else inverse (USDCCY), carried forward; USD is 1."""
    direct = quotes.filter(F.col("pair").endswith("USD")).select(F.substring("pair", 1, 3).alias("ccy"), "date", F.col("rate").alias("d"))
    inverse = quotes.filter(F.col("pair").startswith("USD")).select(F.substring("pair", 4, 3).alias("ccy"), "date", P.ratio(F.lit(1.0), F.col("rate")).alias("i"))
    rows = direct.join(inverse, ["ccy", "date"], "full").select("ccy", "date", F.coalesce("d", "i").alias("usd_per"))
    grid = P.spine(rows, "B", "ccy")
    out = P.reindex(rows, grid, ["ccy", "date"], "ffill", ["usd_per"])
    usd = grid.select(F.lit("USD").alias("ccy"), "date", F.lit(1.0).alias("usd_per")).distinct()
    return out.filter("ccy <> 'USD'").unionByName(usd)


def to_base(prices: DataFrame, fx: DataFrame, base: str = "USD", col: str = "close") -> DataFrame:
    """Prices of (symbol, date, ccy) in the base currency, rates as of each date; unknown currencies give NULL."""
    cross = fx.join(fx.filter(F.col("ccy") == base).select("date", F.col("usd_per").alias("_b")), "date").select("ccy", "date", P.ratio(F.col("usd_per"), F.col("_b")).alias("_fx"))
    return J.asof(prices, cross, "ccy").withColumn(col, F.col(col) * F.col("_fx")).drop("_fx")


def returns_to_base(returns: DataFrame, fx_returns: DataFrame) -> DataFrame:
    """(1 + r)(1 + fx) - 1 by (ccy, date); a missing rate change is 0."""
    rows = returns.join(fx_returns.select("ccy", "date", F.col("fx_ret")), ["ccy", "date"], "left")
    return rows.withColumn("ret", (1 + F.col("ret")) * (1 + F.coalesce("fx_ret", F.lit(0.0))) - 1)


def per_period(annual: Column, periods: int) -> Column:
    """(1 + annual)^(1/periods) - 1."""
    return F.pow(1 + annual, F.lit(1.0 / periods)) - 1


def weekly_rf(interest: DataFrame, weeks: DataFrame, key: str = "country") -> DataFrame:
    """Quarterly annual-percent rates as weekly rates, as of each week, ends filled."""
    rate = interest.select(key, "date", per_period(P.clip(F.col("interest") / 100, -0.99), 52).alias("rf"))
    out = J.asof(weeks, rate, key)
    return out.withColumn("rf", F.coalesce("rf", P.bfill("rf", P.over(key))))


def macro_deltas(levels: DataFrame, log_cols: list[str], diff_cols: list[str], key: str = "country") -> DataFrame:
    """Log differences of positive levels, plain differences of rates."""
    w = P.over(key)
    return levels.select(key, "date", *[F.log(P.ratio(F.col(c), F.lag(c).over(w))).alias(c) for c in log_cols], *[P.diff(c, w).alias(c) for c in diff_cols])


def exponential_midas(lags: int, theta: float) -> list[float]:
    w = np.exp(-theta * np.arange(lags))
    return (w / w.sum()).tolist()


def midas(quarterly: DataFrame, col: str, lags: int = 8, theta: float = 0.3, key: str = "country") -> DataFrame:
    """Weighted lag polynomial of a quarterly series; missing lags drop out."""
    w = P.over(key)
    terms = [F.coalesce(F.lag(col, j).over(w), F.lit(0.0)) * wt for j, wt in enumerate(exponential_midas(lags, theta))]
    return quarterly.withColumn(f"{col}_midas", sum(terms[1:], terms[0]))


def growth_features(quarterly: DataFrame, cols: list[str], key: str = "symbol") -> DataFrame:
    """Quarter-on-quarter and year-on-year changes."""
    w = P.over(key)
    return quarterly.select("*", *[P.pct_change(c, w).alias(f"{c}_qoq") for c in cols], *[P.pct_change(c, w, 4).alias(f"{c}_yoy") for c in cols])


def yoy_or_step(col: str, key: str = "symbol") -> Column:
    """Change over four periods where a symbol has five values and any such change, else over one."""
    w, all_ = P.over(key), Window.partitionBy(key)
    four = P.pct_change(col, w, 4)
    return F.when(F.count(col).over(all_) >= 5, four).otherwise(P.pct_change(col, w, 1))


def lag_features(df: DataFrame, cols: list[str], lags: list[int], key: str = "symbol") -> DataFrame:
    w = P.over(key)
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_l{k}") for c in cols for k in lags])


def windows(df: DataFrame, cols: list[str], n: int, key: str = "symbol") -> DataFrame:
    """The last n rows of the columns as an array of arrays, where there are n."""
    frame = P.over(key).rowsBetween(-(n - 1), 0)
    x = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(frame)
    return df.withColumn("window", x).filter(F.size("window") == n)


def forward_sum(col: str, horizon: int, key: str = "symbol") -> Column:
    """Sum over the next ``horizon`` rows, NULL where fewer follow."""
    frame = P.over(key).rowsBetween(1, horizon)
    return F.when(F.count(col).over(frame) == horizon, F.sum(col).over(frame))


def synthetic_forecast(history: DataFrame, steps: int = 6) -> DataFrame:
    """Low, average and high paths from a symbol's growth without outliers; the first step repeats the last value.

    history: (symbol, date, value).
    """
    g = history.withColumn("g", P.pct_change("value", P.over("symbol"))).filter("g IS NOT NULL")
    g = drop_outliers(g, "g", ["symbol"]).groupBy("symbol").agg(F.min("g").alias("lo"), F.avg("g").alias("av"), F.max("g").alias("hi"))
    last = history.groupBy("symbol").agg(F.max_by("value", "date").alias("base"))
    rows = last.join(g, "symbol").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    avg_before = F.col("base") * F.pow(1 + F.col("av"), F.greatest(F.col("step") - 2, F.lit(0)))
    grow = lambda c: F.when(F.col("step") == 1, F.col("base")).otherwise(avg_before * (1 + F.col(c)))
    return rows.select("symbol", "step", grow("lo").alias("low"), grow("av").alias("avg"), grow("hi").alias("high"))


def cutoffs(df: DataFrame, initial: int, period: int, horizon: int, key: str = "symbol") -> DataFrame:
    """Expanding-window cut-off dates: every ``period`` days from ``initial`` days in to ``horizon`` days before the end."""
    ends = df.groupBy(key).agg(F.date_add(F.min("date"), initial).alias("a"), F.date_sub(F.max("date"), horizon).alias("z")).filter("a <= z")
    return ends.select(key, F.explode(F.sequence("a", "z", F.expr(f"interval {period} days"))).alias("cutoff"))

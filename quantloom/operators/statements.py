"""Company statements and peer groups: pivots, ratios, point-in-time exposures, growth, revisions, peer tables.

Statement items are long (symbol, item, date, value); universes are (symbol, keys, metrics).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import grouped as G
from quantloom.functions import panel as P
from quantloom.operators import align as A
from quantloom.operators import joins as J

#: How industries are folded (first pattern that matches from the start).
INDUSTRY_PATTERNS = (("^Bank", "Banks"), ("^Insurance", "Insurance"), ("^Software", "Software"), ("^Semiconductor", "Semiconductors"), ("^Oil & Gas", "Oil & Gas"), ("^REIT", "REITs"), ("^Utilities", "Utilities"), ("^Drug", "Pharmaceuticals"), ("^Medical", "Medical"))


def sheet(items: DataFrame, names: list[str]) -> DataFrame:
    """Items as columns, one row per symbol and period."""
    return items.groupBy("symbol", "date").pivot("item", names).agg(F.first("value", ignorenulls=True))


def annuals(items: DataFrame) -> DataFrame:
    """Annual inputs of valuation: tax rate, after-tax interest, changes of working capital and of debt.

    Items used: revenue, pretax, tax, interest, working_capital, debt, ocf, capex.
    """
    w = P.over("symbol")
    rows = sheet(items, ["revenue", "pretax", "tax", "interest", "working_capital", "debt", "ocf", "capex"])
    rate = P.clip(P.ratio(F.col("tax"), F.col("pretax")), 0.0, 1.0)
    return rows.withColumn("tax_rate", rate).withColumn("interest_after_tax", F.col("interest") * (1 - F.coalesce(rate, F.lit(0.0)))).withColumn("d_working_capital", P.diff("working_capital", w)).withColumn("net_borrowing", P.diff("debt", w)).withColumn("fcf", F.col("ocf") - F.col("capex"))


def latest_two(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Latest and previous statement of each symbol side by side (prev_<col>)."""
    w = P.over("symbol")
    rows = rows.select("symbol", "date", *cols, *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols])
    return P.keep_last(rows, ["symbol"], [F.col("date")])


def company_kpis(rows: DataFrame) -> DataFrame:
    """Returns on average assets (and the period before), liquidity, margins, turnover and growth statistics.

    rows: symbol, date, net_income, assets, current_assets, current_liabilities, revenue, cogs.
    """
    w = P.over("symbol")
    rows = rows.withColumn("_avg", (F.col("assets") + F.lag("assets").over(w)) / 2).withColumn("roa", P.ratio(F.col("net_income"), F.col("_avg")))
    rows = rows.withColumn("current_ratio", P.ratio(F.col("current_assets"), F.col("current_liabilities"))).withColumn("gross_margin", P.ratio(F.col("revenue") - F.col("cogs"), F.col("revenue"))).withColumn("asset_turnover", P.ratio(F.col("revenue"), F.col("_avg")))
    rows = rows.withColumn("asset_growth", P.pct_change("assets", w))
    kpis = ["roa", "current_ratio", "gross_margin", "asset_turnover"]
    growth = rows.groupBy("symbol").agg(F.avg("asset_growth").alias("asset_growth_rate"), F.stddev_samp("asset_growth").alias("asset_growth_vol"))
    return latest_two(rows, [*kpis, "asset_growth"]).join(growth, "symbol")


def revision_breadth(revisions: DataFrame) -> DataFrame:
    """Estimates raised less lowered over 7 and (net of those) 30 days. revisions: symbol, period, current, ago7, ago30."""
    sign = lambda a, b: F.signum(F.col(a) - F.col(b))
    return revisions.groupBy("symbol").agg(F.coalesce(F.sum(sign("current", "ago7")), F.lit(0.0)).alias("rev_7"), F.coalesce(F.sum(sign("ago7", "ago30")), F.lit(0.0)).alias("rev_30"))


def ratio_kpis(ratios: DataFrame, cols: list[str], span: int = 20, tail: int = 20) -> DataFrame:
    """Exponential last value and trailing mean of each ratio; of 'roe' the geometric mean of the last five, of 'payout' the
    mean absolute of the last five. ratios: symbol, date, cols."""
    schema = "symbol {key}, " + ", ".join(f"{c}_ewm double, {c}_mean double" for c in cols) + ", roe_geo double, payout_5 double"

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        out: list = [symbol]
        for c in cols:
            v = x[c].to_numpy(float)
            m = G.ewm_mean(v, G.alpha_of(span=span))
            t = v[-tail:]
            out += [float(m[-1]) if len(m) and not np.isnan(m[-1]) else None, float(np.nanmean(t)) if len(t) and not np.isnan(t).all() else None]
        five = lambda c: x[c].dropna().to_numpy(float)[-5:] if c in x else np.zeros(0)
        roe, pay = five("roe"), five("payout")
        out += [float(np.expm1(np.log1p(np.maximum(roe, -0.99)).mean())) if len(roe) else None, float(np.abs(pay).mean()) if len(pay) else None]
        return [tuple(out)]

    return G.per_symbol(ratios, "symbol", "date", schema, run)


def fill_history(rows: DataFrame, c: str) -> DataFrame:
    """A ratio's history carried forward, then back, then 0."""
    w = P.over("symbol")
    rows = rows.withColumn(c, P.ffill(c, w))
    return rows.withColumn(c, F.coalesce(P.bfill(c, w), F.lit(0.0)))


def asof_weekly(weeks: DataFrame, statements: DataFrame, lag_days: int = 90) -> DataFrame:
    """Statements as known in each week: published ``lag_days`` after their period."""
    return J.asof_lagged(weeks, statements, lag_days)


def style_exposures(weeks: DataFrame, statements: DataFrame, lag_days: int = 90, coverage: float = 0.6) -> DataFrame:
    """Point-in-time weekly style exposures, robustly scaled across symbols each week.

    weeks: symbol, date, close; statements: symbol, date, net_income, revenue, assets, debt, ocf, shares. Prices lag a week.
    """
    w = P.over("symbol")
    f = statements.withColumn("profit", P.ratio(F.col("net_income"), F.col("assets"))).withColumn("growth", A.yoy_or_step("revenue")).withColumn("lever", P.ratio(F.col("debt"), F.col("assets"))).withColumn("cash", P.ratio(F.col("ocf"), F.col("assets")))
    f = f.withColumn("cash_stability", -P.rolling(F.stddev_samp, "cash", w, 8, 3)).select("symbol", "date", "profit", "growth", "lever", "cash_stability", "net_income", "shares")
    rows = asof_weekly(weeks.withColumn("_p", F.lag("close").over(w)), f, lag_days)
    rows = rows.withColumn("value", P.ratio(F.col("net_income"), F.col("_p") * F.col("shares")))
    for c in ("profit", "growth", "lever", "cash_stability", "value"):
        rows = A.robust_scale(rows, c, ["date"], f"x_{c}", 0.05, coverage)
    return rows.select("symbol", "date", *[f"x_{c}" for c in ("profit", "growth", "lever", "cash_stability", "value")])


def factor_returns(exposures: DataFrame, returns: DataFrame, factors: list[str]) -> DataFrame:
    """Long-short returns of each exposure: sum of z r / sum |z| by date."""
    rows = exposures.join(returns.filter("ret IS NOT NULL"), ["symbol", "date"])
    return rows.groupBy("date").agg(*[P.ratio(F.sum(F.col(x) * F.col("ret")), F.sum(F.when(F.col("ret").isNotNull(), F.abs(x)))).alias(x) for x in factors])


def price_growth_at(reports: DataFrame, prices: DataFrame, days: int = 30) -> DataFrame:
    """Growth of the mean price within +-days of each report."""
    rows = J.range_mean(reports, prices, "close", days, out="price")
    return rows.withColumn("growth", P.pct_change("price", P.over("symbol")))


def forecast_changes(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(new - old) / |old| for columns with new_ and old_ forms; 0 where undefined."""
    return rows.select("symbol", *[F.coalesce(P.ratio(F.col(f"new_{c}") - F.col(f"old_{c}"), F.abs(f"old_{c}")), F.lit(0.0)).alias(c) for c in cols])


def next_estimates(analyst: DataFrame, forecast: DataFrame) -> DataFrame:
    """Analyst estimates beside the first forecast row of each symbol (full outer)."""
    first = P.top_k(forecast, ["symbol"], [F.col("date")], 1)
    return analyst.join(first, "symbol", "full")


def industry(name: Column) -> Column:
    out = name
    for pattern, group in reversed(INDUSTRY_PATTERNS):
        out = F.when(name.rlike(pattern), F.lit(group)).otherwise(out)
    return out


def size_bounds(universe: DataFrame, label: str, size: str) -> DataFrame:
    """(label, lo, hi): each bucket reaches from the last bucket's greatest size to its own; the ends are open."""
    tops = universe.groupBy(label).agg(F.max(size).alias("_m"))
    w = Window.orderBy("_m", label)  # one row a bucket
    last = F.lead("_m").over(w).isNull()
    return tops.select(label, F.lag("_m").over(w).alias("lo"), F.when(last, None).otherwise(F.col("_m")).alias("hi"))


#: Peer levels from fine to coarse.
LEVELS = (("region", "industry"), ("industry", "size"), ("sector", "size"), ("region", "sector"), ("industry",))


def peer_table(universe: DataFrame, keys: tuple[str, ...], metrics: list[str]) -> DataFrame:
    """Means of the metrics by keys, each clipped to the fences of its own group first."""
    return A.clip_outliers(universe, metrics, list(keys)).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def peer_lenses(universe: DataFrame, metrics: list[str], levels=LEVELS, backups: dict[str, str] | None = None) -> DataFrame:
    """symbol -> metric of its peers under each level, as maps; a metric with a backup takes it where it is NULL."""
    out = universe.select("symbol", *dict.fromkeys(k for lv in levels for k in lv))
    for m in metrics:
        out = out.withColumn(m, F.create_map().cast("map<string,double>"))
    for lv in levels:
        table = peer_table(universe, lv, metrics)
        for m, other in (backups or {}).items():
            table = table.withColumn(m, F.coalesce(m, other))
        out = out.join(table.select(*lv, *[F.col(m).alias(f"_{m}") for m in metrics]), list(lv), "left")
        for m in metrics:
            out = out.withColumn(m, F.when(F.col(f"_{m}").isNotNull(), F.map_concat(m, F.create_map(F.lit("-".join(lv)), F.col(f"_{m}")))).otherwise(F.col(m))).drop(f"_{m}")
    return out


def group_statistics(prices: DataFrame, keys: str, periods: int = 252) -> DataFrame:
    """Trailing-year compounded return, volatility and Sharpe of groups of series, with exponential versions (halflife a tenth
    of the year). prices: key, date, close."""

    def run(key, x: pd.DataFrame) -> list[tuple]:
        r = x["close"].pct_change().dropna().to_numpy(float)[-periods:]
        if len(r) < 3:
            return []
        a = G.alpha_of(halflife=max(0.1 * len(r), 1))
        ann, vol = float(np.prod(1 + r) - 1), float(r.std(ddof=1) * np.sqrt(periods))
        return [(key, len(r), ann, vol, ann / vol if vol > 0 else None, float(G.ewm_mean(r, a)[-1] * periods), float(G.ewm_std(r, a)[-1] * np.sqrt(periods)))]

    kind = prices.schema[keys].dataType.simpleString()
    return G.per_symbol(prices.select(keys, "date", "close"), keys, "date", f"{keys} {'string' if kind == 'string' else 'long'}, n long, ret double, vol double, sharpe double, ewm_ret double, ewm_vol double", run)

"""Macro data: country maps, regions, rate conversion, alignment with a fallback country, currency crosses, factor returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import joins as J

#: Regions and the names that a lower-cased country holds, tested in this order.
REGIONS = {
    "United States": ("united states", "usa"),
    "Europe": ("germany", "france", "spain", "europe", "italy", "united kingdom", "ireland"),
    "Canada/Australia": ("australia", "canada"),
    "Asia": ("china", "hong kong", "india", "japan", "south korea", "taiwan", "singapore", "thailand", "vietnam"),
}
OTHER_REGION = "Emerging Mkts (ex-Asia)"
#: The regions of the factor returns.
FACTOR_REGIONS = {
    "North_America": ("united states", "canada"),
    "Europe": ("germany", "france", "spain", "europe", "italy", "united kingdom", "ireland"),
    "Asia_Pacific": ("china", "hong kong", "india", "south korea", "taiwan", "singapore", "thailand", "vietnam", "australia"),
    "Japan": ("japan",),
}
OTHER_FACTOR_REGION = "Emerging_Markets"
FALLBACK = "UNITED STATES"


def canon(name: Column) -> Column:
    return F.lower(F.trim(name))


def region(country: Column, regions: dict[str, tuple[str, ...]] = REGIONS, default: str = OTHER_REGION) -> Column:
    """First region one of whose names the lower-cased country contains; ``default`` where none does or it is NULL."""
    out = None
    for r, names in regions.items():
        hit = canon(country).rlike("|".join(names))
        out = F.when(hit, F.lit(r)) if out is None else out.when(hit, F.lit(r))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def annualised(series: DataFrame, how: str, pct: bool, key: str = "country") -> DataFrame:
    """Yearly mean or last of a series, as change of the year before where ``pct``."""
    agg = F.avg("value") if how == "mean" else F.max_by("value", "date")
    rows = series.groupBy(key, F.year("date").alias("year")).agg(agg.alias("value"))
    return rows.withColumn("value", P.pct_change("value", P.over(key, order="year"))) if pct else rows


def with_fallback(rows: DataFrame, cols: list[str], country: str = FALLBACK, on: str = "date") -> DataFrame:
    """Missing values from the fallback country's row of the same date."""
    base = rows.filter(F.col("country") == country).select(on, *[F.col(c).alias(f"_{c}") for c in cols])
    out = rows.join(base, on, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out


def filled_levels(rows: DataFrame, cols: list[str], key: str = "country") -> DataFrame:
    """Carried forward; what is still missing is 0."""
    w = P.over(key)
    return rows.select(key, "date", *[F.coalesce(P.ffill(c, w), F.lit(0.0)).alias(c) for c in cols])


def for_symbols(symbols: DataFrame, panel: DataFrame, country: str = FALLBACK) -> DataFrame:
    """The panel of each symbol's country, the fallback's where its country has none."""
    known = panel.select("country").distinct().withColumn("_k", F.lit(1))
    keyed = symbols.join(known, "country", "left").withColumn("country", F.when(F.col("_k").isNotNull(), F.col("country")).otherwise(F.lit(country))).drop("_k")
    return keyed.join(panel, "country")


def relative_changes(forecasts: DataFrame, last: str, cols: list[str]) -> DataFrame:
    """Forecasts over the last value, less one."""
    return forecasts.select("country", *[(P.ratio(F.col(c), F.col(last)) - 1).alias(c) for c in cols])


def in_base(quotes: DataFrame, base: str = "GBP") -> DataFrame:
    """Dollar quotes (pair, now, then) as rates of the base currency and their changes.

    xxxUSD pairs give base/xxx as (base USD) / (xxx USD); USDxxx pairs give (base USD) x (USD xxx); the base's own pair stays.
    """
    b = quotes.filter(F.col("pair") == f"{base}USD").select(F.col("now").alias("_n"), F.col("then").alias("_t"))
    rows = quotes.crossJoin(F.broadcast(b.limit(1)))  # one row
    direct, inverse = F.col("pair").endswith("USD"), F.col("pair").startswith("USD")
    conv = lambda x, y: F.when(F.col("pair") == f"{base}USD", F.col(x)).when(direct, P.ratio(F.col(y), F.col(x))).when(inverse, F.col(y) * F.col(x))
    return rows.select("pair", conv("now", "_n").alias("now"), conv("then", "_t").alias("then")).withColumn("change", P.ratio(F.col("then"), F.col("now")) - 1)


def weekly_changes(levels: DataFrame, kinds: dict[str, str], key: str = "country") -> DataFrame:
    """levels: percent change; rates: difference; returns: as they are."""
    w = P.over(key)
    to = {"level": lambda c: P.pct_change(c, w), "rate": lambda c: P.diff(c, w), "return": F.col}
    return levels.select(key, "date", *[to[k](c).alias(c) for c, k in kinds.items()])


def compounded(factors: DataFrame, cols: list[str], rule: str = "QE", percent: bool = True) -> DataFrame:
    """Period returns compounded over a longer period (percent inputs divided by 100)."""
    scale = 100.0 if percent else 1.0
    return factors.groupBy(P.BUCKETS[rule](F.col("date")).alias("date")).agg(*[(F.exp(F.sum(F.log1p(F.col(c) / scale))) - 1).alias(c) for c in cols])


def log_weekly(returns: DataFrame, cols: list[str], day: str = "W-SUN") -> DataFrame:
    """Weekly log returns of daily simple returns."""
    return returns.groupBy(P.BUCKETS[day](F.col("date")).alias("date")).agg(*[F.sum(F.log1p(c)).alias(c) for c in cols])


def year_of_currency(fx: DataFrame) -> DataFrame:
    """Compounded weekly changes of each currency's base rate over its last year. fx: ccy, date, rate."""
    wk = fx.groupBy("ccy", P.week_end("date", "FRI").alias("date")).agg(F.max_by("rate", "date").alias("rate"))
    w = P.over("ccy")
    rows = wk.withColumn("r", P.pct_change("rate", w)).withColumn("_m", F.max("date").over(P.whole("ccy"))).filter(F.col("date") > F.add_months("_m", -12))
    return rows.groupBy("ccy").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("annual"))


def excess_local(returns: DataFrame, rf: DataFrame) -> DataFrame:
    """Returns less the weekly risk-free rate of the symbol's country, as known each week. returns: symbol, country, date, ret;
    rf: country, date, annual percent."""
    weekly = rf.select("country", "date", (F.pow(1 + P.clip(F.col("annual") / 100, -0.99), F.lit(1 / 52)) - 1).alias("rf"))
    return J.asof(returns, weekly, "country").withColumn("excess", F.col("ret") - F.coalesce("rf", F.lit(0.0)))


def implied_correlation(pairs: DataFrame, z: float) -> DataFrame:
    """Correlation implied by the values at risk of two assets and of their equal-weight pair. pairs: a, b, var_a, var_b, var_ab."""
    s = lambda c: F.col(c) / abs(z)
    rho = P.ratio(4 * F.pow(s("var_ab"), F.lit(2)) - F.pow(s("var_a"), F.lit(2)) - F.pow(s("var_b"), F.lit(2)), 2 * s("var_a") * s("var_b"))
    return pairs.select("a", "b", P.clip(rho, -0.99, 0.99).alias("rho"))


def overnight_intraday(bars: DataFrame) -> DataFrame:
    """Log overnight (close to open) and intraday (open to close) returns."""
    w = P.over("symbol")
    return bars.select("symbol", "date", F.log(P.ratio(F.col("open"), F.lag("close").over(w))).alias("overnight"), F.log(P.ratio(F.col("close"), F.col("open"))).alias("intraday"))


def scaled_variance(s: Column, periods: int) -> Column:
    return s * math.sqrt(periods)

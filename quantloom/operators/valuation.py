"""Valuation: multiples over small candidate sets, scenario paths, discounting, growth models.

Candidate sets are arrays of one row (no shuffle); scenario paths are the 3^T digits of a sequence, exploded per symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a predicted price as multiples of today's.
LOW, HIGH = 0.2, 5.0


def present(*cols: Column | str) -> Column:
    """Array of the non-null values."""
    return F.array_compact(F.array(*[F.col(c) if isinstance(c, str) else c for c in cols]))


def product(a: Column, b: Column, fn) -> Column:
    """fn over the cartesian product of two small arrays."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: fn(x, y))))


def clipped(x: Column, price: Column) -> Column:
    return F.greatest(F.least(x, HIGH * price), LOW * price)


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def std_of(a: Column) -> Column:
    """Population deviation."""
    m = mean_of(a)
    return F.sqrt(mean_of(F.transform(a, lambda x: (x - m) * (x - m))))


def summary(df: DataFrame, prices: Column, price: str = "price") -> DataFrame:
    """low, avg, high and the mean and deviation of returns over candidate prices."""
    rows = df.withColumn("_p", prices)
    rows = rows.withColumn("_r", F.transform("_p", lambda x: x / F.col(price) - 1))
    rows = rows.withColumn("low", F.array_min("_p")).withColumn("avg", mean_of(F.col("_p"))).withColumn("high", F.array_max("_p"))
    return rows.withColumn("ret", mean_of(F.col("_r"))).withColumn("se", std_of(F.col("_r"))).drop("_p", "_r")


EPS = ("eps_low", "eps_avg", "eps_high", "eps_low_y", "eps_avg_y", "eps_high_y")
REV = ("rev_low", "rev_avg", "rev_high", "rev_low_y", "rev_avg_y", "rev_high_y")


def floor0(*cols: str) -> list[Column]:
    return [F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))) for c in cols]


def price_earnings(df: DataFrame, multiples: tuple[str, ...]) -> DataFrame:
    p = F.col("price")
    return summary(df, product(present(*floor0(*EPS)), present(*multiples), lambda e, m: F.greatest(clipped(e * m, p), F.lit(0.0))))


def price_sales(df: DataFrame, multiples: tuple[str, ...]) -> DataFrame:
    p = F.col("price")
    return summary(df, product(present(*REV), present(*multiples), lambda r, m: clipped(r * m / F.col("shares"), p)))


def ev_sales(df: DataFrame, multiples: tuple[str, ...]) -> DataFrame:
    p = F.col("price")
    return summary(df, product(present(*REV), present(*multiples), lambda r, m: clipped(r * m / F.col("shares") * F.col("mc_ev"), p)))


def book_value(eps: Column) -> Column:
    return F.greatest(F.col("bvps") + eps - F.col("dps"), F.lit(0.0))


def price_book(df: DataFrame, multiples: tuple[str, ...]) -> DataFrame:
    p = F.col("price")
    return summary(df, product(present(*EPS), present(*multiples), lambda e, m: clipped(book_value(e) * m, p)))


def graham(df: DataFrame, pes: tuple[str, ...], pbs: tuple[str, ...]) -> DataFrame:
    """sqrt(PE EPS PB book value) over earnings x multiples."""
    p = F.col("price")
    pairs = product(present(*pes), present(*pbs), lambda a, b: a * b)
    return summary(df, product(present(*EPS), pairs, lambda e, m: clipped(F.sqrt(m * F.greatest(e, F.lit(0.0)) * book_value(e)), p)))


def relative_value(df: DataFrame, pes: tuple[str, ...], pss: tuple[str, ...], pbs: tuple[str, ...]) -> DataFrame:
    """All candidates of the multiples together; the error is their deviation over sqrt(5)."""
    p = F.col("price")
    all_ = F.concat(
        product(present(*floor0(*EPS)), present(*pes), lambda e, m: clipped(e * m, p)),
        product(present(*REV), present(*pss), lambda r, m: clipped(r * m / F.col("shares"), p)),
        product(present(*EPS), present(*pbs), lambda e, m: clipped(book_value(e) * m, p)),
    )
    return summary(df, all_).withColumn("se", F.col("se") / F.sqrt(F.lit(5.0)))


def capm(returns: DataFrame, bench: DataFrame, market_vol: float, rf: float, market_return: float) -> DataFrame:
    """beta, rf + beta (rm - rf), and |beta vol / correlation| (correlation 1 where it is 0 or unknown)."""
    rows = returns.join(bench, "date").groupBy("symbol").agg(F.regr_slope("ret", "bench").alias("beta"), F.corr("ret", "bench").alias("rho"))
    rho = F.when(F.col("rho").isNull() | (F.col("rho") == 0), 1.0).otherwise(F.col("rho"))
    return rows.select("symbol", "beta", (rf + F.col("beta") * (market_return - rf)).alias("exp_return"), F.abs(F.col("beta") * market_vol / rho).alias("volatility"))


def gordon(df: DataFrame, spread: float = 0.01, least_yield: float = 0.01) -> DataFrame:
    """dps (1 + g) / (coe - g), clipped; NULL under the least yield. The spread keeps the denominator positive."""
    value = F.col("dps") * (1 + F.col("g")) / F.greatest(F.col("coe") - F.col("g"), F.lit(spread))
    return df.withColumn("ggm", F.when(F.col("dps") / F.col("price") >= least_yield, clipped(value, F.col("price"))))


def sustainable_growth(roe: str, payout: str, industry: str) -> Column:
    """ROE (1 - payout); the industry's where ROE is negative."""
    return F.when(F.col(roe) < 0, F.col(industry)).otherwise(F.col(roe) * (1 - F.col(payout)))


def geometric_growth(df: DataFrame, x: str, key: str = "symbol", low: float = -0.8, high: float = 5.0) -> DataFrame:
    """Geometric mean growth of a positive series per key, clipped."""
    from pyspark.sql import Window

    g = F.log(F.try_divide(F.col(x), F.lag(x).over(Window.partitionBy(key).orderBy("date"))))
    return df.withColumn("_g", g).groupBy(key).agg(F.least(F.greatest(F.exp(F.avg("_g")) - 1, F.lit(low)), F.lit(high)).alias("growth"))


def discount_factors(rate: Column, days: Column) -> Column:
    """(1 + rate)^(-days / 365)."""
    return F.pow(1 + rate, -days / 365.0)


def wacc(coe: Column, equity: Column, cod: Column, debt: Column) -> Column:
    v = F.coalesce(equity, F.lit(0.0)) + F.coalesce(debt, F.lit(0.0))
    return F.try_divide(coe * equity + cod * F.coalesce(debt, F.lit(0.0)), v)


def cost_of_debt(rate_percent: Column, tax: Column) -> Column:
    return rate_percent * (1 - tax) / 100


def paths(df: DataFrame, years: int) -> DataFrame:
    """Every low / average / high choice per year: 3^years rows a symbol, ``pick`` holds the choices."""
    rows = df.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(3**years - 1))))
    return rows.withColumn("pick", F.array(*[F.floor(F.col("path") / 3**t) % 3 for t in range(years)]))


def at(values: str, t: int) -> Column:
    """The path's value of an array of [low, avg, high] triples in year t (from 0)."""
    return F.element_at(F.element_at(values, t + 1), (F.element_at("pick", t + 1) + 1).cast("int"))


def dcf(df: DataFrame, years: int, multiples: tuple[str, ...]) -> DataFrame:
    """Discounted cash flows over all paths: free cash flow b0 + b1 revenue + b2 earnings each year, plus a terminal value by
    each multiple of the last year's earnings; P10, median and P90 of the price.

    df: symbol, price, shares, rate, b0, b1, b2, rev (array of triples), eps (array of triples), multiples.
    """
    rows = paths(df, years)
    flow = lambda t: F.col("b0") + F.col("b1") * at("rev", t) + F.col("b2") * at("eps", t)
    pv = sum((flow(t) * F.pow(1 + F.col("rate"), F.lit(-(t + 1.0))) for t in range(years)), F.lit(0.0))
    rows = rows.withColumn("_pv", pv).withColumn("_last", F.greatest(at("eps", years - 1), F.lit(0.0)) * F.pow(1 + F.col("rate"), F.lit(-float(years))))
    rows = rows.withColumn("_m", F.explode(present(*multiples)))
    price = clipped(F.col("_pv") / F.col("shares") + F.col("_m") * F.col("_last"), F.col("price"))
    rows = rows.withColumn("_v", price)
    return rows.groupBy("symbol").agg(F.first("price").alias("price"), *[F.percentile("_v", F.lit(q)).alias(n) for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))], F.stddev_pop("_v").alias("sd"))


def residual_income(df: DataFrame, years: int, payout: str = "payout") -> DataFrame:
    """Book value plus discounted residual incomes eps - coe x last book value over all paths, book value rolled forward.

    df: symbol, price, bvps, coe, payout, g, eps (array of triples).
    """
    rows = paths(df, years)
    eps = F.array(*[at("eps", t) for t in range(years)])
    start = F.struct(F.col("bvps").alias("book"), F.lit(0.0).alias("value"), F.lit(1.0).alias("disc"), F.lit(0.0).alias("last"))

    def step(acc, e):
        disc = acc["disc"] / (1 + F.col("coe"))
        income = e - F.col("coe") * acc["book"]
        book = F.greatest(acc["book"] + e - F.greatest(e, F.lit(0.0)) * F.col(payout), F.lit(0.0))
        return F.struct(book.alias("book"), (acc["value"] + disc * income).alias("value"), disc.alias("disc"), income.alias("last"))

    rows = rows.withColumn("_a", F.aggregate(eps, start, step))
    spread = F.greatest(F.col("coe") - F.col("g"), F.lit(0.01))
    value = F.col("bvps") + F.col("_a.value") + F.col("_a.disc") * F.col("_a.last") * (1 + F.col("g")) / spread
    rows = rows.withColumn("_v", clipped(value, F.col("price")))
    return rows.groupBy("symbol").agg(F.first("price").alias("price"), F.avg("_v").alias("value"), F.stddev_pop("_v").alias("sd"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def scenarios(revenue: DataFrame, eps: DataFrame, macro: DataFrame) -> DataFrame:
    """Revenue x earnings scenarios of each symbol with its macro row."""
    return revenue.join(eps, "symbol").join(macro, "symbol", "left")


def vasicek(betas: DataFrame, least: float = 1e-6) -> DataFrame:
    """Shrinks each beta to the mean by its own error: tau2 = max(var(beta) - mean(se^2), least)."""
    one = betas.agg(F.avg("beta").alias("_m"), F.greatest(F.var_samp("beta") - F.avg(F.col("se") * F.col("se")), F.lit(least)).alias("_t"))  # one row
    w = F.col("_t") / (F.col("_t") + F.col("se") * F.col("se"))
    return betas.crossJoin(F.broadcast(one)).withColumn("beta_shrunk", w * F.col("beta") + (1 - w) * F.col("_m")).drop("_m", "_t")


def unlever(beta: Column, tax: Column, d_to_e: Column) -> Column:
    return beta / (1 + (1 - tax) * d_to_e)


def relever(beta: Column, tax: Column, d_to_e: Column) -> Column:
    return beta * (1 + (1 - tax) * d_to_e)


def cost_of_equity(beta: Column, rf: Column, premium: Column, country_risk: Column) -> Column:
    """rf + beta x premium (at least 4 %) + country risk, at least 6 %."""
    return F.greatest(rf + F.greatest(beta * F.greatest(premium, F.lit(0.04)), F.lit(0.0)) + F.coalesce(country_risk, F.lit(0.0)), F.lit(0.06))

"""Queries over currencies, rates, macro series and estimates: the smaller operators, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import align as A
from quantloom.operators import joins as J
from quantloom.operators import macro as M
from quantloom.operators import metrics as X
from quantloom.operators import statements as S
from quantloom.operators import valuation as V
from quantloom.plans.companies import ST_SQL, statements
from quantloom.plans.fundamentals import INPUT_SQL, TRIPLES, scenario_inputs
from quantloom.plans.models import floats
from quantloom.plans.panels import QUARTERS, quarters
from quantloom.plans.performance import RETS, weekly_returns
from quantloom.plans.technical import WIN, R, rounded
from quantloom.sources.tables import BARS_SQL, UNIVERSE_SQL, bars, parquet, universe

Q: dict = {}
SQL: dict[str, str] = {}
BY = "OVER (PARTITION BY country ORDER BY date)"
UP = "OVER (PARTITION BY country ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def query(name, sql=None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("fourier_terms", f"WITH {RETS}, d AS (SELECT DISTINCT date FROM r), t AS (SELECT date, date_diff('day', DATE '1970-01-01', date) / 365.25 AS t FROM d) SELECT date, " + ", ".join(f"round({f}(t * {2 * 3.141592653589793 * j!r}), 6) AS year_{f}{j}" for j in (1, 2) for f in ("sin", "cos")) + " FROM t")
def fourier_terms(spark, d):
    t = F.unix_date("date") / 365.25
    return floats(weekly_returns(spark, d).select("date").distinct().select("date", *P.fourier(t, 1.0, 2, "year")))


SUFFIXES = [*A.SUFFIX_CCY, "", ".XX"]
TICKER_SQL = f"'S' || s_suppkey || ({'[' + ', '.join(repr(s) for s in SUFFIXES) + ']'})[1 + s_suppkey % {len(SUFFIXES)}]"


@query("suffix_currencies", f"WITH t AS (SELECT {TICKER_SQL} AS ticker FROM supplier) SELECT ticker, CASE regexp_extract(ticker, '(\\.[A-Z]+)$', 1) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in A.SUFFIX_CCY.items())} ELSE 'USD' END AS ccy FROM t")
def suffix_currencies(spark, d):
    s = parquet(spark, d, "supplier")
    at = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (1 + F.col("s_suppkey") % len(SUFFIXES)).cast("int"))
    t = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), at).alias("ticker"))
    return t.select("ticker", A.suffix_currency(F.col("ticker")).alias("ccy"))


@query("returns_in_base", f"WITH {RETS}, {UNIVERSE_SQL}, j AS (SELECT symbol, date, ret, region AS ccy FROM r JOIN universe USING (symbol)), f AS (SELECT ccy, date, avg(ret) AS fx FROM j WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) % 3 <> 0) SELECT j.symbol, j.ccy, j.date, round((1 + ret) * (1 + coalesce(fx, 0)) - 1, 6) AS ret FROM j LEFT JOIN f ON f.ccy = j.ccy AND f.date = j.date")
def returns_in_base(spark, d):
    j = weekly_returns(spark, d).join(universe(spark, d).select("symbol", F.col("region").alias("ccy")), "symbol")
    fx = j.filter("ret IS NOT NULL").groupBy("ccy", "date").agg(F.avg("ret").alias("fx_ret"), F.count(F.lit(1)).alias("n")).filter("n % 3 <> 0")
    return floats(A.returns_to_base(j, fx).select("symbol", "ccy", "date", "ret"))


RATES = f"{QUARTERS}, rate AS (SELECT country, date, 1.0 + n % 7 AS interest FROM qs), wks AS (SELECT DISTINCT country, CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) - 70 AS date FROM qs)"


def rates(spark, d):
    q = quarters(spark, d)
    return q.select("country", "date", (1.0 + F.col("n") % 7).alias("interest")), q.select("country", F.date_sub(P.week_end("date"), 70).alias("date")).distinct()


@query("weekly_risk_free", f"WITH {RATES}, p AS (SELECT w.country, w.date, CASE WHEN interest IS NOT NULL THEN pow(1 + greatest(interest / 100, -0.99), 1 / 52.0::DOUBLE) - 1 END AS rf FROM wks w ASOF LEFT JOIN rate r ON r.country = w.country AND r.date <= w.date) SELECT country, date, round(1e6 * coalesce(rf, first_value(rf IGNORE NULLS) {UP}), 4) AS rf FROM p")
def weekly_risk_free(spark, d):
    rate, weeks = rates(spark, d)
    return A.weekly_rf(rate, weeks).select("country", "date", R(F.col("rf") * 1e6, 4).alias("rf"))


@query("macro_deltas", f"WITH {QUARTERS} SELECT country, date, round(ln(sales / nullif(lag(sales) {BY}, 0)), 6) AS sales, n - lag(n) {BY} AS n FROM qs")
def macro_deltas(spark, d):
    return floats(A.macro_deltas(quarters(spark, d), ["sales"], ["n"]))


@query("backtest_cutoffs", f"WITH {BARS_SQL}, e AS (SELECT symbol, min(date) + 400 AS a, max(date) - 90 AS z FROM bars GROUP BY symbol) SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 180 DAY)) AS DATE) AS cutoff FROM e WHERE a <= z")
def backtest_cutoffs(spark, d):
    return A.cutoffs(bars(spark, d), 400, 180, 90)


PIVOT = f"{QUARTERS}, q AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC) AS k FROM qs), w AS (SELECT country, max(sales) FILTER (k = 3) AS last, max(sales) FILTER (k = 2) AS q1, max(sales) FILTER (k = 1) AS q2 FROM q GROUP BY country)"


def last_quarters(spark, d):
    from pyspark.sql import Window

    q = quarters(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("country").orderBy(F.col("date").desc())))
    return q.groupBy("country").agg(*[F.max(F.when(F.col("k") == k, F.col("sales"))).alias(c) for k, c in ((3, "last"), (2, "q1"), (1, "q2"))])


@query("forecast_over_last", f"WITH {PIVOT} SELECT country, round(q1 / nullif(last, 0) - 1, 6) AS q1, round(q2 / nullif(last, 0) - 1, 6) AS q2 FROM w")
def forecast_over_last(spark, d):
    return floats(M.relative_changes(last_quarters(spark, d), "last", ["q1", "q2"]))


DAILY = f"{BARS_SQL}, b AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM bars)"


@query("log_weekly_returns", f"WITH {DAILY}, m AS (SELECT date, avg(ret) AS m FROM b WHERE ret IS NOT NULL GROUP BY date) SELECT CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) AS date, round(sum(ln(1 + m)), 6) AS m FROM m GROUP BY 1")
def log_weekly_returns(spark, d):
    daily = bars(spark, d).withColumn("ret", P.pct_change("close", P.over("symbol"))).filter("ret IS NOT NULL").groupBy("date").agg(F.avg("ret").alias("m"))
    return floats(M.log_weekly(daily, ["m"]))


@query("currency_years", f"""WITH {BARS_SQL}, f AS (SELECT symbol % 5 AS ccy, date, avg(close) AS rate FROM bars GROUP BY ALL), wk AS (SELECT ccy, CAST(date + CAST(((5 - isodow(date) + 7) % 7) AS INTEGER) AS DATE) AS date, arg_max(rate, date) AS rate FROM f GROUP BY ALL),
x AS (SELECT ccy, date, rate / lag(rate) OVER (PARTITION BY ccy ORDER BY date) - 1 AS r, max(date) OVER (PARTITION BY ccy) AS m FROM wk) SELECT ccy, round(exp(sum(ln(1 + r))) - 1, 6) AS annual FROM x WHERE date > CAST(m - INTERVAL 12 MONTH AS DATE) GROUP BY ccy""")
def currency_years(spark, d):
    fx = bars(spark, d).groupBy((F.col("symbol") % 5).alias("ccy"), "date").agg(F.avg("close").alias("rate"))
    return floats(M.year_of_currency(fx))


@query("excess_of_local_rate", f"WITH {RETS}, {QUARTERS}, u AS (SELECT s_suppkey AS symbol, s_nationkey AS country FROM supplier), rate AS (SELECT country, date, pow(1 + greatest((1.0 + n % 7) / 100, -0.99), 1 / 52.0::DOUBLE) - 1 AS rf FROM qs), j AS (SELECT r.symbol, u.country, r.date, r.ret FROM r JOIN u USING (symbol)) SELECT j.symbol, j.date, round(ret - coalesce(rf, 0), 6) AS excess FROM j ASOF LEFT JOIN rate ON rate.country = j.country AND rate.date <= j.date")
def excess_of_local_rate(spark, d):
    u = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("country"))
    rate, _ = rates(spark, d)
    out = M.excess_local(weekly_returns(spark, d).join(u, "symbol"), rate.withColumnRenamed("interest", "annual"))
    return floats(out.select("symbol", "date", "excess"))


@query("implied_correlations", f"""WITH {RETS}, v AS (SELECT symbol, -quantile_cont(ret, 0.05) AS v FROM r GROUP BY symbol), p AS (SELECT x.symbol AS a, x.symbol + 1 AS b, -quantile_cont((x.ret + y.ret) / 2, 0.05) AS v FROM r x JOIN r y ON y.symbol = x.symbol + 1 AND y.date = x.date WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL)
SELECT p.a, p.b, round(least(greatest((4 * pow(p.v, 2) - pow(s.v, 2) - pow(t.v, 2)) / nullif(2 * s.v * t.v, 0), -0.99), 0.99), 6) AS rho FROM p JOIN v s ON s.symbol = p.a JOIN v t ON t.symbol = p.b""")
def implied_correlations(spark, d):
    r = weekly_returns(spark, d)
    v = r.groupBy("symbol").agg((-F.percentile("ret", F.lit(0.05))).alias("v"))
    y = r.select((F.col("symbol") - 1).alias("symbol"), "date", F.col("ret").alias("other")).filter("other IS NOT NULL")
    pair = r.filter("ret IS NOT NULL").join(y, ["symbol", "date"]).groupBy(F.col("symbol").alias("a")).agg((-F.percentile((F.col("ret") + F.col("other")) / 2, F.lit(0.05))).alias("var_ab")).withColumn("b", F.col("a") + 1)
    pair = pair.join(v.select(F.col("symbol").alias("a"), F.col("v").alias("var_a")), "a").join(v.select(F.col("symbol").alias("b"), F.col("v").alias("var_b")), "b")
    return floats(M.implied_correlation(pair, 1.6448536269514722))


@query("filled_ratio_history", f"WITH {ST_SQL}, g AS (SELECT symbol, date, CASE WHEN month(date) % 2 = 0 AND symbol % 3 <> 0 THEN net_income / assets END AS roa FROM st), f AS (SELECT symbol, date, last_value(roa IGNORE NULLS) {WIN} AS roa FROM g) SELECT symbol, date, round(coalesce(first_value(roa IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS roa FROM f")
def filled_ratio_history(spark, d):
    st = statements(spark, d).select("symbol", "date", F.when((F.month("date") % 2 == 0) & (F.col("symbol") % 3 != 0), F.col("net_income") / F.col("assets")).alias("roa"))
    return floats(S.fill_history(st, "roa"))


@query("estimate_changes", f"WITH {PIVOT} SELECT country::BIGINT AS symbol, round(coalesce((q2 - q1) / nullif(abs(q1), 0), 0), 6) AS sales FROM w")
def estimate_changes(spark, d):
    w = last_quarters(spark, d).select(F.col("country").cast("long").alias("symbol"), F.col("q2").alias("new_sales"), F.col("q1").alias("old_sales"))
    return floats(S.forecast_changes(w, ["sales"]))


@query("next_estimates", f"WITH {QUARTERS}, a AS (SELECT country::BIGINT AS symbol, avg(sales) AS target FROM qs WHERE country % 2 = 0 GROUP BY 1), f AS (SELECT country::BIGINT AS symbol, date, sales FROM qs WHERE country % 3 = 0 QUALIFY row_number() OVER (PARTITION BY country ORDER BY date) = 1) SELECT coalesce(a.symbol, f.symbol) AS symbol, round(target, 2) AS target, date, round(sales, 2) AS sales FROM a FULL JOIN f USING (symbol)")
def next_estimates(spark, d):
    q = quarters(spark, d).select(F.col("country").cast("long").alias("symbol"), "date", "sales")
    analyst = q.filter("symbol % 2 = 0").groupBy("symbol").agg(F.avg("sales").alias("target"))
    return rounded(S.next_estimates(analyst, q.filter("symbol % 3 = 0")).select("symbol", "target", "date", "sales"), "target", "sales", n=2)


@query("growth_rates", f"WITH {ST_SQL}, l AS (SELECT symbol, avg(net_income / assets) AS roe, avg(0.3 + n0 % 5 / 10.0) AS payout FROM (SELECT *, symbol AS n0 FROM st) GROUP BY symbol), g AS (SELECT symbol, ln(revenue / nullif(lag(revenue) {WIN}, 0)) AS g FROM st), e AS (SELECT symbol, least(greatest(exp(avg(g)) - 1, -0.8), 5) AS growth FROM g GROUP BY symbol) SELECT symbol, round(growth, 6) AS growth, round(CASE WHEN roe < 0 THEN growth ELSE roe * (1 - payout) END, 6) AS sustainable FROM e JOIN l USING (symbol)")
def growth_rates(spark, d):
    st = statements(spark, d)
    last = st.groupBy("symbol").agg(F.avg(F.col("net_income") / F.col("assets")).alias("roe"), F.avg(0.3 + F.col("symbol") % 5 / 10.0).alias("payout"))
    rows = V.geometric_growth(st, "revenue").join(last, "symbol")
    return floats(rows.select("symbol", "growth", V.sustainable_growth("roe", "payout", "growth").alias("sustainable")))


@query("discount_factors", "SELECT DISTINCT o_orderdate::DATE AS date, round(pow(1.07, -date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 365.0::DOUBLE), 6) AS factor FROM orders")
def discount_factors(spark, d):
    o = parquet(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return floats(o.select("date", V.discount_factors(F.lit(0.07), F.datediff("date", F.lit("1995-01-01"))).alias("factor")))


LABELS = {"EUROPE": "Europe", "ASIA": "Asia", "AMERICA": "United States"}


@query("region_labels", "SELECT r_name, CASE r_name WHEN 'EUROPE' THEN 'Europe' WHEN 'ASIA' THEN 'Asia' WHEN 'AMERICA' THEN 'United States' ELSE 'Other' END AS label FROM region")
def region_labels(spark, d):
    return J.map_lookup(parquet(spark, d, "region").select("r_name"), "r_name", LABELS, "label", "Other")


@query("common_dates", f"WITH {BARS_SQL} SELECT date FROM bars INTERSECT SELECT o_orderdate::DATE AS date FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def common_dates(spark, d):
    o = parquet(spark, d, "orders")
    first = o.agg(F.min("o_orderpriority").alias("o_orderpriority"))
    return J.common_dates([bars(spark, d), o.join(F.broadcast(first), "o_orderpriority").select(F.to_date("o_orderdate").alias("date"))])


KPI = f"""WITH RECURSIVE {ST_SQL}, k AS (SELECT symbol, date, assets / revenue AS ev, net_income / assets AS roe, abs(ocf / net_income) AS pay, row_number() {WIN} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM st),
m AS (SELECT symbol, i, n, ev AS m FROM k WHERE i = 1 UNION ALL SELECT k.symbol, k.i, k.n, 19 / 21.0::DOUBLE * m + 2 / 21.0::DOUBLE * ev FROM m JOIN k ON k.symbol = m.symbol AND k.i = m.i + 1)
SELECT k.symbol, round(any_value(m.m), 6) AS ev_sales_ewm, round(avg(ev) FILTER (k.i > k.n - 20), 6) AS ev_sales_mean, round(exp(avg(ln(1 + greatest(roe, -0.99))) FILTER (k.i > k.n - 5)) - 1, 6) AS roe_geo, round(avg(pay) FILTER (k.i > k.n - 5), 6) AS payout_5 FROM k JOIN m ON m.symbol = k.symbol AND m.i = m.n GROUP BY k.symbol"""


@query("ratio_kpis", KPI)
def ratio_kpis(spark, d):
    r = statements(spark, d).selectExpr("symbol", "date", "assets / revenue AS ev_sales", "net_income / assets AS roe", "ocf / net_income AS payout")
    return floats(S.ratio_kpis(r, ["ev_sales"]))


def _income() -> str:
    book, value, steps = "bvps", "bvps", []
    for t in range(3):
        steps.append(f"s{t} AS (SELECT *, eps[{t + 1}][(path // {3**t}) % 3 + 1] AS e{t}, {book} AS book{t}, eps[{t + 1}][(path // {3**t}) % 3 + 1] - coe * {book} AS i{t} FROM {'x' if not t else f's{t - 1}'})")
        value += f" + i{t} * pow(1 + coe, -{t + 1})"
        book = f"greatest(book{t} + e{t} - greatest(e{t}, 0) * payout, 0)"
    tail = " + pow(1 + coe, -3) * i2 * (1 + g) / greatest(coe - g, 0.01)"
    return f"""WITH {INPUT_SQL}, p AS (SELECT *, unnest(range(0, 27)) AS path FROM inputs), x AS (SELECT *, {TRIPLES('eps')} AS eps FROM p), {', '.join(steps)}, v AS (SELECT symbol, price, CASE WHEN {value}{tail} IS NOT NULL THEN least(greatest({value}{tail}, 0.2 * price), 5 * price) END AS v FROM s2)
SELECT symbol, price::DOUBLE AS price, round(avg(v), 5) AS value, round(stddev_pop(v), 5) AS sd, round(min(v), 5) AS low, round(max(v), 5) AS high FROM v GROUP BY symbol, price"""


@query("residual_income", _income())
def residual_income(spark, d):
    return rounded(V.residual_income(scenario_inputs(spark, d), 3), "value", "sd", "low", "high", n=5)


@query("predicted_shortfalls", f"""WITH {RETS}, a AS (SELECT symbol, avg(ret) * 52 AS er, stddev_samp(ret) * sqrt(52) AS vol, avg(ret) AS mu, stddev_pop(ret) AS sp, avg(ret * ret) AS m2, avg(ret * ret * ret) AS m3, avg(ret * ret * ret * ret) AS m4 FROM r GROUP BY symbol),
b AS (SELECT *, (m3 - 3 * mu * m2 + 2 * mu * mu * mu) / pow(sp, 3) AS s, (m4 - 4 * mu * m3 + 6 * mu * mu * m2 - 3 * pow(mu, 4)) / pow(sp, 4) AS k, CAST({X.S.norm_ppf(0.05)!r} AS DOUBLE) AS z FROM a), c AS (SELECT *, z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * (k - 3) / 24 - (2 * z * z * z - 5 * z) * s * s / 36 AS y FROM b)
SELECT symbol, round(-er / 52 + vol / sqrt(52) * exp(-y * y / 2) / sqrt(2 * pi()) / 0.05, 6) AS shortfall FROM c""")
def predicted_shortfalls(spark, d):
    r = weekly_returns(spark, d).groupBy("symbol").agg((F.avg("ret") * 52).alias("er"), X.annual_vol().alias("vol"), X.skew().alias("s"), X.kurt().alias("k"))
    return floats(r.select("symbol", X.predicted_shortfall(F.col("er"), F.col("vol"), F.col("s"), F.col("k")).alias("shortfall")))

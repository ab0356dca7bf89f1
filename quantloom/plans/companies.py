"""Queries over statements, peers and macro series, with DuckDB oracles. Orders by customer nation stand in for statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import macro as M
from quantloom.operators import statements as S
from quantloom.plans.models import floats
from quantloom.plans.panels import QUARTERS, quarters
from quantloom.plans.performance import RETS, weekly_returns
from quantloom.plans.technical import R, BARS_SQL, WIN, rounded
from quantloom.sources.tables import bars, parquet

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


#: Statement items derived from a nation's quarterly sales s and order count n.
ITEMS = {"revenue": "s", "cogs": "s * 0.6", "net_income": "s * 0.1 - n * 1000", "assets": "s * 3 + n * 5000", "current_assets": "s * 1.2", "current_liabilities": "s * 0.8 + n", "debt": "s + n * 100", "ocf": "s * 0.15 - n * 500", "shares": "1000.0 + n"}
ST_SQL = f"{QUARTERS}, st AS (SELECT country::BIGINT AS symbol, date, {', '.join(f'{e} AS {c}' for c, e in ITEMS.items())} FROM (SELECT country, date, sales AS s, n FROM qs))"


def statements(spark, d):
    q = quarters(spark, d).select(F.col("country").cast("long").alias("symbol"), "date", F.col("sales").alias("s"), "n")
    return q.selectExpr("symbol", "date", *[f"CAST({e.replace('0.', '0.')} AS DOUBLE) AS {c}" for c, e in ITEMS.items()])


@query("company_kpis", f"WITH {ST_SQL}, a AS (SELECT *, (assets + lag(assets) {WIN}) / 2 AS av, assets / lag(assets) {WIN} - 1 AS g FROM st), k AS (SELECT symbol, date, net_income / av AS roa, current_assets / current_liabilities AS cr, (revenue - cogs) / revenue AS gm, revenue / av AS turn, g FROM a), p AS (SELECT *, lag(roa) {WIN} AS proa, lag(cr) {WIN} AS pcr FROM k), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), v AS (SELECT symbol, avg(g) AS gr, stddev_samp(g) AS gv FROM a GROUP BY symbol) SELECT symbol, date, round(roa, 6) AS roa, round(proa, 6) AS prev_roa, round(cr, 6) AS current_ratio, round(pcr, 6) AS prev_current_ratio, round(gm, 6) AS gross_margin, round(turn, 6) AS asset_turnover, round(gr, 6) AS asset_growth_rate, round(gv, 6) AS asset_growth_vol FROM l JOIN v USING (symbol)")
def company_kpis(spark, d):
    k = S.company_kpis(statements(spark, d))
    return floats(k.select("symbol", "date", "roa", "prev_roa", "current_ratio", "prev_current_ratio", "gross_margin", "asset_turnover", "asset_growth_rate", "asset_growth_vol"))


@query("statement_sheet", f"WITH {ST_SQL} SELECT symbol, date, round(revenue, 2) AS revenue, round(debt, 2) AS debt FROM st")
def statement_sheet(spark, d):
    long = statements(spark, d).unpivot(["symbol", "date"], ["revenue", "debt", "assets"], "item", "value")
    return rounded(S.sheet(long, ["revenue", "debt"]), "revenue", "debt", n=2)


@query("annual_inputs", f"WITH {ST_SQL}, a AS (SELECT symbol, date, revenue, net_income AS pretax, net_income * 0.2 AS tax, debt * 0.01 AS interest, current_assets - current_liabilities AS working_capital, debt, ocf, assets * 0.01 AS capex FROM st), b AS (SELECT *, least(greatest(tax / nullif(pretax, 0), 0), 1) AS rate FROM a) SELECT symbol, date, round(revenue, 4) AS revenue, round(pretax, 4) AS pretax, round(tax, 4) AS tax, round(interest, 4) AS interest, round(working_capital, 4) AS working_capital, round(debt, 4) AS debt, round(ocf, 4) AS ocf, round(capex, 4) AS capex, round(rate, 4) AS tax_rate, round(interest * (1 - coalesce(rate, 0)), 4) AS interest_after_tax, round(working_capital - lag(working_capital) {WIN}, 4) AS d_working_capital, round(debt - lag(debt) {WIN}, 4) AS net_borrowing, round(ocf - capex, 4) AS fcf FROM b")
def annual_inputs(spark, d):
    st = statements(spark, d).selectExpr("symbol", "date", "revenue", "net_income AS pretax", "net_income * 0.2 AS tax", "debt * 0.01 AS interest", "current_assets - current_liabilities AS working_capital", "debt", "ocf", "assets * 0.01 AS capex")
    long = st.unpivot(["symbol", "date"], st.columns[2:], "item", "value")
    return floats(S.annuals(long), 4)


STYLES = ("profit", "growth", "lever", "cash_stability", "value")


def scaled_sql(c: str) -> str:
    """CTEs that scale a column of ``x`` by date as the operator does."""
    return f"""q_{c} AS (SELECT date, quantile_cont({c}, 0.05) AS lo, quantile_cont({c}, 0.95) AS hi, count({c}) / count(*) AS cov FROM x GROUP BY date),
w_{c} AS (SELECT symbol, date, cov, CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo), hi) END AS v FROM x JOIN q_{c} USING (date)), m_{c} AS (SELECT date, median(v) AS m, stddev_samp(v) AS sd FROM w_{c} GROUP BY date), d_{c} AS (SELECT date, 1.4826 * median(abs(v - m)) AS mad FROM w_{c} JOIN m_{c} USING (date) GROUP BY date),
z_{c} AS (SELECT symbol, date, CASE WHEN cov >= 0.6 AND v IS NOT NULL THEN CASE WHEN mad > 0 THEN (v - m) / mad WHEN sd > 0 THEN (v - m) / sd ELSE 0 END END AS x_{c} FROM w_{c} JOIN m_{c} USING (date) LEFT JOIN d_{c} USING (date))"""


STYLE_SQL = f"""WITH {RETS}, {ST_SQL}, own AS (SELECT s_suppkey AS symbol, st.date, revenue, net_income * (1 + s_suppkey % 5) AS net_income, assets, debt * (1 + s_suppkey % 3) AS debt, ocf * (1 + s_suppkey % 4) AS ocf, shares * (1 + s_suppkey % 7) AS shares FROM supplier JOIN st ON st.symbol = s_nationkey),
f AS (SELECT symbol, date, net_income / nullif(assets, 0) AS profit, CASE WHEN count(revenue) OVER (PARTITION BY symbol) >= 5 THEN revenue / nullif(lag(revenue, 4) {WIN}, 0) - 1 ELSE revenue / nullif(lag(revenue) {WIN}, 0) - 1 END AS growth, debt / nullif(assets, 0) AS lever, ocf / nullif(assets, 0) AS cash, net_income, shares FROM own),
f2 AS (SELECT *, CASE WHEN count(cash) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) >= 3 THEN -stddev_samp(cash) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS cash_stability, date + 90 AS known FROM f),
wk2 AS (SELECT symbol, date, lag(close) {WIN} AS p FROM wk), x AS (SELECT w.symbol, w.date, profit, growth, lever, cash_stability, net_income / nullif(p * shares, 0) AS value FROM wk2 w ASOF LEFT JOIN f2 ON f2.symbol = w.symbol AND f2.known <= w.date), {', '.join(scaled_sql(c) for c in STYLES)},
e AS (SELECT * FROM z_profit JOIN z_growth USING (symbol, date) JOIN z_lever USING (symbol, date) JOIN z_cash_stability USING (symbol, date) JOIN z_value USING (symbol, date))"""


def own_statements(spark, d):
    """Statements of each symbol: its nation's, some items scaled by the symbol's number."""
    n = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("own"), F.col("s_nationkey").cast("long").alias("symbol"))
    rows = statements(spark, d).join(n, "symbol")
    return rows.selectExpr("own AS symbol", "date", "revenue", "net_income * (1 + own % 5) AS net_income", "assets", "debt * (1 + own % 3) AS debt", "ocf * (1 + own % 4) AS ocf", "shares * (1 + own % 7) AS shares")


def exposures(spark, d):
    return S.style_exposures(P.resample(bars(spark, d), "W-SUN", {"close": "last"}), own_statements(spark, d))


@query("style_exposures", f"{STYLE_SQL} SELECT symbol, date, {', '.join(f'round(x_{c}, 5) AS x_{c}' for c in STYLES)} FROM e")
def style_exposures(spark, d):
    return floats(exposures(spark, d), 5)


@query("style_factor_returns", f"{STYLE_SQL} SELECT date, {', '.join(f'round(sum(x_{c} * ret) / nullif(sum(abs(x_{c})), 0), 6) AS x_{c}' for c in ('profit', 'value', 'lever'))} FROM e JOIN r USING (symbol, date) WHERE ret IS NOT NULL GROUP BY date")
def style_factor_returns(spark, d):
    return floats(S.factor_returns(exposures(spark, d), weekly_returns(spark, d), ["x_profit", "x_value", "x_lever"]))


@query("report_price_growth", f"WITH {BARS_SQL}, y AS (SELECT DISTINCT symbol, make_date(year(date)::BIGINT, 12, 31) AS date FROM bars), p AS (SELECT y.symbol, y.date, avg(b.close) AS price FROM y LEFT JOIN bars b ON b.symbol = y.symbol AND b.date BETWEEN y.date - 30 AND y.date + 30 GROUP BY ALL) SELECT symbol, date, round(price, 6) AS price, round(price / lag(price) {WIN} - 1, 6) AS growth FROM p")
def report_price_growth(spark, d):
    b = bars(spark, d)
    y = b.select("symbol", P.year_end("date").alias("date")).distinct()
    return floats(S.price_growth_at(y, b).select("symbol", "date", "price", "growth"))


@query("revision_breadth", f"WITH {QUARTERS} SELECT country AS symbol, coalesce(sum(sign(sales - 1000000)), 0)::DOUBLE AS rev_7, coalesce(sum(sign(1000000 - n * 100000)), 0)::DOUBLE AS rev_30 FROM qs GROUP BY 1")
def revision_breadth(spark, d):
    q = quarters(spark, d).select(F.col("country").alias("symbol"), F.col("sales").alias("current"), F.lit(1000000.0).alias("ago7"), (F.col("n") * 100000.0).alias("ago30"))
    return S.revision_breadth(q)


PU = "pu AS (SELECT p_partkey AS symbol, 'R' || (p_partkey % 3) AS region, p_brand AS industry, split_part(p_type, ' ', 1) AS sector, CASE WHEN p_size < 20 THEN 'S' ELSE 'L' END AS size, p_retailprice AS pe, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size::DOUBLE END AS ps FROM part)"


def peer_universe(spark, d):
    p = parquet(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("symbol"), F.concat(F.lit("R"), k % 3).alias("region"), F.col("p_brand").alias("industry"), F.split("p_type", " ")[0].alias("sector"), F.when(F.col("p_size") < 20, "S").otherwise("L").alias("size"), F.col("p_retailprice").alias("pe"), F.when(k % 4 == 0, None).otherwise(F.col("p_size").cast("double")).alias("ps"))


def _peer(name, keys):
    cols = ", ".join(keys)

    @query(name, f"WITH {PU}, q AS (SELECT {cols}, quantile_cont(pe, 0.25) AS a, quantile_cont(pe, 0.75) AS b, quantile_cont(ps, 0.25) AS c, quantile_cont(ps, 0.75) AS e FROM pu GROUP BY ALL) SELECT {cols}, round(avg(least(greatest(pe, a - 1.5 * (b - a)), b + 1.5 * (b - a))), 6) AS pe, round(avg(CASE WHEN ps IS NOT NULL THEN least(greatest(ps, c - 1.5 * (e - c)), e + 1.5 * (e - c)) END), 6) AS ps, count(*) AS n FROM pu JOIN q USING ({cols}) GROUP BY ALL")
    def run(spark, d):
        return floats(S.peer_table(peer_universe(spark, d), keys, ["pe", "ps"]))


for _keys in S.LEVELS:
    _peer("peers_" + "_".join(_keys), _keys)


@query("peer_lenses", f"""WITH {PU}, q AS (SELECT region, industry, quantile_cont(pe, 0.25) AS a, quantile_cont(pe, 0.75) AS b, quantile_cont(ps, 0.25) AS c, quantile_cont(ps, 0.75) AS e FROM pu GROUP BY ALL), p AS (SELECT region, industry, avg(least(greatest(pe, a - 1.5 * (b - a)), b + 1.5 * (b - a))) AS pe, avg(CASE WHEN ps IS NOT NULL THEN least(greatest(ps, c - 1.5 * (e - c)), e + 1.5 * (e - c)) END) AS ps FROM pu JOIN q USING (region, industry) GROUP BY ALL),
q2 AS (SELECT industry, quantile_cont(pe, 0.25) AS a, quantile_cont(pe, 0.75) AS b, quantile_cont(ps, 0.25) AS c, quantile_cont(ps, 0.75) AS e FROM pu GROUP BY ALL), p2 AS (SELECT industry, avg(least(greatest(pe, a - 1.5 * (b - a)), b + 1.5 * (b - a))) AS pe2, avg(CASE WHEN ps IS NOT NULL THEN least(greatest(ps, c - 1.5 * (e - c)), e + 1.5 * (e - c)) END) AS ps2 FROM pu JOIN q2 USING (industry) GROUP BY ALL)
SELECT symbol, round(p.pe, 6) AS pe_region_industry, round(pe2, 6) AS pe_industry, round(coalesce(p.ps, p.pe), 6) AS ps_region_industry, round(coalesce(ps2, pe2), 6) AS ps_industry FROM pu JOIN p USING (region, industry) JOIN p2 USING (industry)""")
def peer_lenses(spark, d):
    out = S.peer_lenses(peer_universe(spark, d), ["pe", "ps"], backups={"ps": "pe"})
    return out.select("symbol", *[R(F.element_at(m, lens), 6).alias(f"{m}_{lens.replace('-', '_')}") for m in ("pe", "ps") for lens in ("region-industry", "industry")])


@query("size_bounds", f"WITH {PU}, m AS (SELECT size, max(pe) AS m FROM pu GROUP BY 1) SELECT size, lag(m) OVER (ORDER BY m, size) AS lo, CASE WHEN lead(m) OVER (ORDER BY m, size) IS NULL THEN NULL ELSE m END AS hi FROM m")
def size_bounds(spark, d):
    return S.size_bounds(peer_universe(spark, d), "size", "pe")


@query("regions_of_countries", """SELECT n_name, CASE WHEN lower(n_name) LIKE '%united states%' OR lower(n_name) LIKE '%usa%' THEN 'United States'
  WHEN regexp_matches(lower(n_name), 'germany|france|spain|europe|italy|united kingdom|ireland') THEN 'Europe' WHEN regexp_matches(lower(n_name), 'australia|canada') THEN 'Canada/Australia'
  WHEN regexp_matches(lower(n_name), 'china|hong kong|india|japan|south korea|taiwan|singapore|thailand|vietnam') THEN 'Asia' ELSE 'Emerging Mkts (ex-Asia)' END AS region,
  CASE WHEN regexp_matches(lower(n_name), 'united states|canada') THEN 'North_America' WHEN regexp_matches(lower(n_name), 'germany|france|spain|europe|italy|united kingdom|ireland') THEN 'Europe'
  WHEN regexp_matches(lower(n_name), 'china|hong kong|india|south korea|taiwan|singapore|thailand|vietnam|australia') THEN 'Asia_Pacific' WHEN lower(n_name) LIKE '%japan%' THEN 'Japan' ELSE 'Emerging_Markets' END AS factor_region FROM nation""")
def regions_of_countries(spark, d):
    name = F.col("n_name")
    return parquet(spark, d, "nation").select("n_name", M.region(name).alias("region"), M.region(name, M.FACTOR_REGIONS, M.OTHER_FACTOR_REGION).alias("factor_region"))


@query("annual_macro", f"WITH {QUARTERS}, y AS (SELECT country, year(date)::INTEGER AS year, avg(sales) AS v FROM qs GROUP BY ALL) SELECT country, year, round(v / lag(v) OVER (PARTITION BY country ORDER BY year) - 1, 6) AS value FROM y")
def annual_macro(spark, d):
    return floats(M.annualised(quarters(spark, d).withColumnRenamed("sales", "value"), "mean", True).select("country", "year", "value"))


@query("macro_fallback", f"WITH {QUARTERS}, g AS (SELECT country, date, CASE WHEN n % 3 = 0 THEN NULL ELSE sales END AS sales FROM qs) SELECT g.country, g.date, round(coalesce(g.sales, u.sales), 2) AS sales FROM g LEFT JOIN (SELECT date, sales FROM g WHERE country = 24) u USING (date)")
def macro_fallback(spark, d):
    g = quarters(spark, d).select("country", "date", F.when(F.col("n") % 3 == 0, None).otherwise(F.col("sales")).alias("sales"))
    return rounded(M.with_fallback(g, ["sales"], 24), "sales", n=2)


@query("macro_changes", f"WITH {QUARTERS} SELECT country, date, round(sales / lag(sales) OVER w - 1, 6) AS sales, n - lag(n) OVER w AS n FROM qs WINDOW w AS (PARTITION BY country ORDER BY date)")
def macro_changes(spark, d):
    return rounded(M.weekly_changes(quarters(spark, d), {"sales": "level", "n": "rate"}), "sales")


@query("compounded_factors", f"WITH {RETS}, b AS (SELECT date, avg(ret) AS f, max(ret) AS g FROM r WHERE ret IS NOT NULL GROUP BY 1) SELECT last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS date, round(exp(sum(ln(1 + f))) - 1, 3) AS f, round(exp(sum(ln(1 + g / 100))) - 1, 3) AS g FROM b GROUP BY 1")
def compounded_factors(spark, d):
    b = weekly_returns(spark, d).filter("ret IS NOT NULL").groupBy("date").agg(F.avg("ret").alias("f"), F.max("ret").alias("g"))
    return floats(M.compounded(b.withColumn("f", F.col("f") * 100), ["f", "g"]), 3)


@query("overnight_intraday", f"WITH {BARS_SQL} SELECT symbol, date, round(ln(open / lag(close) {WIN}), 6) AS overnight, round(ln(close / open), 6) AS intraday FROM bars")
def overnight_intraday(spark, d):
    return floats(M.overnight_intraday(bars(spark, d)))


@query("base_currency_quotes", '''WITH q(pair, now, "then") AS (VALUES ('GBPUSD', 1.25::DOUBLE, 1.30::DOUBLE), ('EURUSD', 1.1, 1.05), ('USDJPY', 150.0, 140.0)), b AS (SELECT now AS n, "then" AS t FROM q WHERE pair = 'GBPUSD'), c AS (SELECT pair, CASE WHEN pair = 'GBPUSD' THEN now WHEN pair LIKE '%USD' THEN n / now ELSE n * now END AS now, CASE WHEN pair = 'GBPUSD' THEN "then" WHEN pair LIKE '%USD' THEN t / "then" ELSE t * "then" END AS "then" FROM q, b) SELECT pair, round(now, 6) AS now, round("then", 6) AS "then", round("then" / now - 1, 6) AS change FROM c''')
def base_currency_quotes(spark, d):
    q = spark.createDataFrame([("GBPUSD", 1.25, 1.30), ("EURUSD", 1.1, 1.05), ("USDJPY", 150.0, 140.0)], "pair string, now double, then double")
    return floats(M.in_base(q))


@query("group_statistics")
def group_statistics(spark, d):
    from quantloom.sources.tables import universe

    b = bars(spark, d).join(universe(spark, d).select("symbol", "region"), "symbol").groupBy("region", "date").agg(F.avg("close").alias("close"))
    return floats(S.group_statistics(b, "region"))

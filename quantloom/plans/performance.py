"""Queries over weekly returns: performance, risk, benchmark-relative and holdings metrics, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import metrics as M
from quantloom.plans.panels import WEEKLY
from quantloom.plans.technical import ROLL, WIN, rounded
from quantloom.sources.tables import UNIVERSE_SQL, bars, bars_in_parts, stored, universe

Q: dict = {}
SQL: dict[str, str] = {}

RETS = f"{WEEKLY}, r AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM wk)"
BENCH = "bench AS (SELECT date, median(ret) AS bench FROM r WHERE ret IS NOT NULL GROUP BY date)"
RFW = repr(M.RF_WEEK)
ANN = "CASE WHEN count(*) <= 1 THEN 0 ELSE exp(sum(ln(1 + ret)) * 52 / count(*)) - 1 END"


def query(name, sql=None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql if sql.startswith("WITH") else f"WITH {RETS}, {sql}" if not sql.startswith("SELECT") else f"WITH {RETS} {sql}"
        return fn

    return add


def weekly_returns(spark, d, daily=None):
    wk = P.resample(bars(spark, d) if daily is None else daily, "W-SUN", {"close": "last"})
    return wk.select("symbol", "date", P.pct_change("close", P.over("symbol")).alias("ret"))


def benchmark(r):
    return r.filter("ret IS NOT NULL").groupBy("date").agg(F.percentile("ret", F.lit(0.5)).alias("bench"))


def six(df, key="symbol"):
    return rounded(df, *[c for c, t in df.dtypes if c != key and t == "double"])


@query("performance_summary", f"""a AS (SELECT symbol, count(ret) AS n, {ANN} AS ann_return, stddev_samp(ret) * sqrt(52) AS ann_vol, avg(ret) AS mu, stddev_pop(ret) AS sp, avg(ret * ret) AS m2, avg(ret * ret * ret) AS m3, avg(ret * ret * ret * ret) AS m4,
  -quantile_cont(ret, 0.05) AS var_historic, sum(greatest(ret, 0)) / nullif(sum(greatest(-ret, 0)), 0) AS omega, quantile_cont(ret, 0.9) / abs(quantile_cont(ret, 0.1)) AS tail_ratio,
  avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS pct_positive, avg(CASE WHEN ret < {RFW} THEN pow(ret - {RFW}, 2) END) AS sd_down, sum(CASE WHEN ret < {RFW} THEN pow(ret - {RFW}, 2) ELSE 0 END) / count(ret) AS sd_all FROM r GROUP BY symbol)
SELECT symbol, n, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round((ann_return - 0.038) / ann_vol, 6) AS sharpe, round((m3 - 3 * mu * m2 + 2 * mu * mu * mu) / pow(sp, 3), 6) AS skew, round((m4 - 4 * mu * m3 + 6 * mu * mu * m2 - 3 * pow(mu, 4)) / pow(sp, 4), 6) AS kurtosis,
  round(var_historic, 6) AS var_historic, round(omega, 6) AS omega, round(tail_ratio, 6) AS tail_ratio, round((ann_return - 0.038) / (sqrt(sd_down) * sqrt(52)), 6) AS sortino, round((ann_return - 0.038) / (sqrt(sd_all) * sqrt(52)), 6) AS sortino_all, round(pct_positive, 6) AS pct_positive, round((ann_return - 0.038) / var_historic, 6) AS raroc FROM a""")
def performance_summary(spark, d):
    return six(M.summary(weekly_returns(spark, d)).drop("var_gaussian", "var_modified", "mean_sd"))


@query("value_at_risk", f"""a AS (SELECT symbol, avg(ret) AS mu, stddev_pop(ret) AS sp, avg(ret * ret) AS m2, avg(ret * ret * ret) AS m3, avg(ret * ret * ret * ret) AS m4 FROM r GROUP BY symbol),
b AS (SELECT symbol, mu, sp, (m3 - 3 * mu * m2 + 2 * mu * mu * mu) / pow(sp, 3) AS s, (m4 - 4 * mu * m3 + 6 * mu * mu * m2 - 3 * pow(mu, 4)) / pow(sp, 4) AS k, CAST({M.S.norm_ppf(0.05)!r} AS DOUBLE) AS z FROM a)
SELECT symbol, round(-(mu + z * sp), 6) AS var_gaussian, round(-(mu + (z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * (k - 3) / 24 - (2 * z * z * z - 5 * z) * s * s / 36) * sp), 6) AS var_modified FROM b""")
def value_at_risk(spark, d):
    return six(M.summary(weekly_returns(spark, d)).select("symbol", "var_gaussian", "var_modified"))


@query("expected_shortfall", "q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q FROM r GROUP BY symbol) SELECT symbol, round(coalesce(-avg(ret) FILTER (ret <= q), 0), 6) AS cvar FROM r JOIN q USING (symbol) GROUP BY symbol")
def expected_shortfall(spark, d):
    return six(M.expected_shortfall(weekly_returns(spark, d)))


DD = f"w AS (SELECT symbol, date, 1000 * exp(sum(ln(1 + ret)) {WIN}) AS wealth FROM r WHERE ret IS NOT NULL), dd AS (SELECT *, max(wealth) {WIN} AS peak FROM w), ds AS (SELECT symbol, date, wealth, peak, (wealth - peak) / peak AS drawdown FROM dd)"


@query("drawdowns", f"{DD} SELECT symbol, date, round(wealth, 4) AS wealth, round(peak, 4) AS peak, round(drawdown, 6) AS drawdown FROM ds")
def drawdowns(spark, d):
    rows = M.drawdowns(weekly_returns(spark, d)).select("symbol", "date", "wealth", "peak", "drawdown")
    return rounded(rounded(rows, "wealth", "peak", n=4), "drawdown")


@query("drawdown_metrics", f"{DD}, q AS (SELECT symbol, min(drawdown) AS mx, sqrt(avg(drawdown * drawdown)) AS ulcer, -avg(drawdown) AS pain, quantile_cont(drawdown, 0.05) AS q FROM ds GROUP BY symbol), c AS (SELECT symbol, avg(drawdown) AS cdar FROM ds JOIN q USING (symbol) WHERE drawdown <= q GROUP BY symbol), a AS (SELECT symbol, {ANN} AS ann FROM r GROUP BY symbol) SELECT symbol, round(mx, 6) AS max_drawdown, round(ulcer, 6) AS ulcer, round(pain, 6) AS pain, round(cdar, 6) AS cdar, round(ann / abs(mx), 6) AS calmar, round((ann - 0.038) / pain, 6) AS pain_ratio FROM q JOIN c USING (symbol) JOIN a USING (symbol)")
def drawdown_metrics(spark, d):
    return six(M.drawdown_metrics(weekly_returns(spark, d)))


@query("streaks", "s AS (SELECT symbol, date, sign(ret) AS s FROM r WHERE ret IS NOT NULL), g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, s ORDER BY date) AS g FROM s), l AS (SELECT symbol, s, g, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT symbol, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS p FROM s GROUP BY symbol) SELECT l.symbol, round(any_value(p), 6) AS pct_positive, coalesce(max(n) FILTER (s > 0), 0) AS win_run, coalesce(max(n) FILTER (s < 0), 0) AS loss_run FROM l JOIN p USING (symbol) GROUP BY l.symbol")
def streaks(spark, d):
    return six(M.streaks(weekly_returns(spark, d)))


@query("benchmark_relative", f"""{BENCH}, j AS (SELECT symbol, ret, bench, ret - {RFW} AS y, bench - {RFW} AS x FROM r JOIN bench USING (date) WHERE ret IS NOT NULL),
a AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS ic, regr_r2(y, x) AS r2, stddev_samp(ret - bench) AS te, exp(sum(ln(1 + ret)) * 52 / count(*)) - 1 AS ap, exp(sum(ln(1 + bench)) * 52 / count(*)) - 1 AS ab, stddev_samp(ret) * sqrt(52) AS vp, stddev_samp(bench) * sqrt(52) AS vb,
 regr_slope(ret, bench) FILTER (bench > 0) AS us, regr_slope(ret, bench) FILTER (bench < 0) AS dn, avg(ret) FILTER (bench > 0) / avg(bench) FILTER (bench > 0) AS ur, avg(ret) FILTER (bench < 0) / avg(bench) FILTER (bench < 0) AS dr FROM j GROUP BY symbol)
SELECT symbol, n, round(beta, 6) AS beta, round(r2, 6) AS r2, round(te, 6) AS tracking_error, round((ap - ab) / te, 6) AS information_ratio, round((ap - 0.038) / beta, 4) AS treynor, round(us, 6) AS up_slope, round(dn, 6) AS down_slope, round(ur, 6) AS up_ratio, round(dr, 6) AS down_ratio, round(0.038 + (ap - 0.038) / vp * vb, 6) AS m2 FROM a""")
def benchmark_relative(spark, d):
    r = weekly_returns(spark, d)
    out = M.relative(r, benchmark(r)).drop("alpha")
    return rounded(rounded(out, *[c for c in out.columns if c not in ("symbol", "n", "treynor")]), "treynor", n=4)


@query("alpha_hac", f"""{BENCH}, j AS (SELECT symbol, ret - {RFW} AS y, bench - {RFW} AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM r JOIN bench USING (date) WHERE ret IS NOT NULL),
f AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x) AS sx, sum(x * x) AS sxx, sum(pow(y, 2)) - pow(sum(y), 2) / count(*) AS sst FROM j GROUP BY symbol HAVING count(*) >= 10),
e AS (SELECT symbol, i, n, x, y - a - b * x AS e FROM j JOIN f USING (symbol)),
k AS (SELECT DISTINCT symbol, n, unnest(range(0, greatest(1, floor(pow(n, 0.25)))::BIGINT + 1)) AS k FROM f),
g AS (SELECT u.symbol, sum(w.m * u.e * v.e) AS s00, sum(w.m * u.e * v.e * (u.x + v.x) / 2) AS s01, sum(w.m * u.e * v.e * u.x * v.x) AS s11 FROM e u JOIN (SELECT symbol, k, CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / (greatest(1, floor(pow(n, 0.25))) + 1)) END AS m FROM k) w USING (symbol) JOIN e v ON v.symbol = u.symbol AND v.i = u.i - w.k GROUP BY u.symbol),
h AS (SELECT *, n * sxx - sx * sx AS det FROM f JOIN g USING (symbol) JOIN (SELECT symbol, sum(e * e) AS sse FROM e GROUP BY symbol) USING (symbol)),
c AS (SELECT symbol, n, pow(1 + a, 52) - 1 AS alpha, b AS beta, 1 - sse / sst AS r2, a / sqrt((sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / (det * det)) AS alpha_t, sqrt((sx * sx * s00 - 2 * sx * n * s01 + n * n * s11) / (det * det)) AS beta_se FROM h)
SELECT symbol, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2, round(alpha_t, 6) AS alpha_t, round(beta_se, 6) AS beta_se FROM c""")
def alpha_hac(spark, d):
    r = weekly_returns(spark, d)
    return six(M.alpha_hac(r, benchmark(r)))


#: The column function's approximation of the normal distribution.
CDF = lambda x: f"(CASE WHEN {x} >= 0 THEN 1 - {TAIL(x)} ELSE {TAIL(x)} END)"
T1 = lambda x: f"(1 / (1 + 0.5::DOUBLE * (abs({x}) / sqrt(2))))"


def TAIL(x: str) -> str:  # noqa: N802
    poly = "0.17087277::DOUBLE"
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {T1(x)} + ({k!r})::DOUBLE)"
    return f"(0.5::DOUBLE * {T1(x)} * exp(-pow(abs({x}) / sqrt(2), 2) + {poly}))"


@query("probabilistic_sharpe", f"""a AS (SELECT symbol, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(ret) AS mu, stddev_pop(ret) AS sp, avg(ret * ret) AS m2, avg(ret * ret * ret) AS m3, avg(ret * ret * ret * ret) AS m4 FROM r GROUP BY symbol),
b AS (SELECT *, (m3 - 3 * mu * m2 + 2 * mu * mu * mu) / pow(sp, 3) AS s, (m4 - 4 * mu * m3 + 6 * mu * mu * m2 - 3 * pow(mu, 4)) / pow(sp, 4) AS k, (SELECT stddev_samp(sr) FROM a) * {M.S.expected_max_normal(100)!r}::DOUBLE AS best FROM a),
c AS (SELECT symbol, sr, sr * sqrt(n - 1) / sqrt(1 - s * sr + (k - 1) / 4 * sr * sr) AS x, (sr - best) * sqrt(n - 1) / sqrt(1 - s * sr + (k - 1) / 4 * sr * sr) AS y FROM b)
SELECT symbol, round(sr, 5) AS sr, round({CDF('x')}, 5) AS psr, round({CDF('y')}, 5) AS dsr FROM c""")
def probabilistic_sharpe(spark, d):
    r = weekly_returns(spark, d)
    s = r.groupBy("symbol").agg(F.count("ret").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), M.skew().alias("s"), M.kurt().alias("k"))
    sd = s.agg(F.stddev_samp("sr").alias("sd"))  # one row
    s = s.crossJoin(F.broadcast(sd))
    out = s.select("symbol", "sr", M.probabilistic_sharpe(F.col("sr"), F.lit(0.0), F.col("n"), F.col("s"), F.col("k")).alias("psr"), M.deflated_sharpe(F.col("sr"), F.col("n"), F.col("s"), F.col("k"), 100, F.col("sd")).alias("dsr"))
    return rounded(out, "sr", "psr", "dsr", n=5)


WTS = f"{UNIVERSE_SQL}, weights AS (SELECT region AS holdings, symbol, mcap / sum(mcap) OVER (PARTITION BY region) AS weight FROM universe WHERE mcap > 0)"


def weights(spark, d):
    from pyspark.sql import Window

    return universe(spark, d).filter("mcap > 0").select(F.col("region").alias("holdings"), "symbol", (F.col("mcap") / F.sum("mcap").over(Window.partitionBy("region"))).alias("weight"))


@query("holdings_returns", f"{WTS} SELECT holdings, date, round(sum(weight * ret) / sum(weight), 6) AS ret, round(sum(weight), 6) AS coverage FROM weights JOIN r USING (symbol) WHERE ret IS NOT NULL GROUP BY ALL")
def holdings_returns(spark, d):
    return rounded(M.holdings_returns(weights(spark, d), weekly_returns(spark, d)), "ret", "coverage")


@query("holdings_volatility", f"{WTS}, c AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS cov FROM r x JOIN r y ON x.date = y.date WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL) SELECT wa.holdings, round(sqrt(sum(wa.weight * wb.weight * cov)), 6) AS volatility FROM c JOIN weights wa ON wa.symbol = a JOIN weights wb ON wb.symbol = b AND wb.holdings = wa.holdings GROUP BY 1")
def holdings_volatility(spark, d):
    return rounded(M.holdings_risk(weights(spark, d), weekly_returns(spark, d)), "volatility")


@query("covariance_pairs", "SELECT x.symbol AS a, y.symbol AS b, round(covar_samp(x.ret, y.ret), 6) AS cov, round(corr(x.ret, y.ret), 6) AS corr, count(*) AS n FROM r x JOIN r y ON x.date = y.date AND x.symbol <= y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL")
def covariance_pairs(spark, d):
    return rounded(M.covariances(*[weekly_returns(spark, d, part) for part in bars_in_parts(spark, d)]), "cov", "corr")


@query("holdings_exposures", f"{WTS}, {BENCH}, j AS (SELECT symbol, regr_slope(ret, bench) AS beta FROM r JOIN bench USING (date) GROUP BY symbol) SELECT holdings, round(sum(weight * beta), 6) AS beta, round(sum(weight * mcap), 4) AS mcap FROM weights JOIN j USING (symbol) JOIN universe USING (symbol) GROUP BY 1")
def holdings_exposures(spark, d):
    r = weekly_returns(spark, d)
    beta = r.join(benchmark(r), "date").groupBy("symbol").agg(F.regr_slope("ret", "bench").alias("beta"))
    out = M.weighted(weights(spark, d), beta.join(universe(spark, d).select("symbol", "mcap"), "symbol"), ["beta", "mcap"])
    return rounded(rounded(out, "beta"), "mcap", n=4)


@query("ewm_sharpe", f"""WITH RECURSIVE {RETS}, o AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL), q AS (SELECT *, 1 - exp(-ln(2.0::DOUBLE) / (0.1::DOUBLE * n)) AS a FROM o),
w AS (SELECT symbol, i, n, ret AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS w2 FROM q WHERE i = 1 UNION ALL SELECT q.symbol, q.i, q.n, w.m + a * (ret - w.m), (1 - a) * (w.v + a * (ret - w.m) * (ret - w.m)), (1 - a) * (1 - a) * w.w2 + a * a FROM w JOIN q ON q.symbol = w.symbol AND q.i = w.i + 1),
z AS (SELECT symbol, m * 52 AS er, CASE WHEN 1 - w2 > 1e-12 THEN sqrt(v / (1 - w2)) * sqrt(52) END AS ev FROM w WHERE i = n AND n >= 3)
SELECT s.symbol, round(er, 6) AS ewm_return, round(ev, 6) AS ewm_vol, round(CASE WHEN ev > 0 THEN (er - 0.038) / ev END, 6) AS ewm_sharpe FROM (SELECT DISTINCT symbol FROM r) s LEFT JOIN z USING (symbol)""")
def ewm_sharpe(spark, d):
    return six(M.ewm_sharpe(weekly_returns(spark, d)))


@query("metrics_report", f"""WITH p AS ({SQL['performance_summary']}), v AS ({SQL['value_at_risk']}), e AS ({SQL['expected_shortfall']}), d AS ({SQL['drawdown_metrics']}), k AS ({SQL['streaks']}), b AS ({SQL['benchmark_relative']})
SELECT p.* EXCLUDE (omega, tail_ratio), var_gaussian, var_modified, cvar, max_drawdown, ulcer, pain, cdar, calmar, pain_ratio, win_run, loss_run, beta, r2, tracking_error, information_ratio, treynor, up_slope, down_slope, up_ratio, down_ratio, m2
FROM p LEFT JOIN v USING (symbol) LEFT JOIN e USING (symbol) LEFT JOIN d USING (symbol) LEFT JOIN k USING (symbol) LEFT JOIN b USING (symbol)""")
def metrics_report(spark, d):
    r = stored(spark, weekly_returns(spark, d), "weekly-returns")  # one scan of the bars for all parts
    out = M.report(r, benchmark(r)).drop("omega", "tail_ratio", "alpha", "mean_sd")
    return rounded(rounded(out, *[c for c, t in out.dtypes if t == "double" and c not in ("symbol", "treynor")]), "treynor", n=4)


@query("capacity_bounds", f"""{UNIVERSE_SQL}, s AS (SELECT symbol, avg(ret) AS er, stddev_samp(ret) AS vol FROM r GROUP BY symbol),
dv AS (SELECT symbol, date, CASE WHEN count(close * volume) {ROLL(20)} >= 12 THEN avg(close * volume) {ROLL(20)} END AS adv FROM bars), l AS (SELECT symbol, arg_max(adv, date) AS adv FROM dv GROUP BY symbol),
ix AS (SELECT *, abs(close / lag(close) {WIN} - 1) / nullif(close * volume, 0) AS x FROM bars), ia AS (SELECT symbol, date, CASE WHEN count(x) {ROLL(60)} >= 36 THEN avg(x) {ROLL(60)} END AS m FROM ix), io AS (SELECT symbol, arg_max(m, date) AS m FROM ia GROUP BY symbol), i AS (SELECT symbol, coalesce(m, (SELECT median(m) FROM io)) AS amihud FROM io),
a AS (SELECT symbol, region AS sector, CASE WHEN er > 0 AND er / vol > 0 THEN pow(mcap, 0.5) * (1 + pow(er / vol, 0.5) * pow(0.25, 0.5)) / pow(vol, 0.5) * pow(adv, 0.25) / (1 + amihud) ELSE 0 END AS c FROM universe JOIN s USING (symbol) JOIN l USING (symbol) JOIN i USING (symbol) WHERE mcap > 0),
e AS (SELECT quantile_cont(c, 0.05) AS lo, quantile_cont(c, 0.95) AS hi FROM a WHERE c > 0), b AS (SELECT symbol, sector, CASE WHEN c > 0 THEN least(greatest(c, lo), hi) ELSE 0 END AS c FROM a, e), w AS (SELECT *, c / nullif(sum(c) OVER (), 0) AS w FROM b),
x AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY sector) > 0.15 THEN w * 0.15 / sum(w) OVER (PARTITION BY sector) ELSE w END AS w2 FROM w), u AS (SELECT *, least(w2, 0.08) AS u, CASE WHEN c > 0 THEN 0.08 - least(w2, 0.08) ELSE 0 END AS room FROM x),
t AS (SELECT 1 - sum(u) AS spare, sum(room) AS rooms FROM u)
SELECT symbol, sector, 0.0::DOUBLE AS lower, round(coalesce(u + greatest(0, least(room, room / nullif(rooms, 0) * greatest(spare, 0))), 0), 6) AS upper FROM u, t""")
def capacity_bounds(spark, d):
    from quantloom.operators import indicators as I

    b, r = bars(spark, d), weekly_returns(spark, d)
    s = r.groupBy("symbol").agg(F.avg("ret").alias("er"), F.stddev_samp("ret").alias("vol")).withColumn("score", F.col("er") / F.col("vol")).withColumn("r2", F.lit(0.25))
    a = universe(spark, d).select("symbol", F.col("region").alias("sector"), "mcap").join(s, "symbol").join(I.liquidity(b), "symbol").join(I.amihud(b), "symbol")
    return rounded(M.capacity(a.filter("mcap > 0")), "upper")

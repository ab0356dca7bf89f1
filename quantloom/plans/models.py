"""Queries over estimators, covariance, allocations, forecasts, simulations and stream twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import estimators as E
from quantloom.operators import forecast as X
from quantloom.operators import holdings as O
from quantloom.operators import valuation as V
from quantloom.plans.fundamentals import inputs
from quantloom.plans.panels import quarters
from quantloom.plans.performance import BENCH, RETS, benchmark, weekly_returns
from quantloom.plans.technical import R, rounded
from quantloom.sources.tables import UNIVERSE_SQL, bars, parquet, universe
from quantloom.streaming import events as S

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def weekly(spark, d):
    return P.resample(bars(spark, d), "W-SUN", {"close": "last"})


def floats(df, n=6):
    return rounded(df, *[c for c, t in df.dtypes if t == "double"], n=n)


@query("betas_blended")
def betas_blended(spark, d):
    r = weekly_returns(spark, d)
    return floats(E.betas(r, benchmark(r)))


@query("beta_ols", f"WITH {RETS}, {BENCH} SELECT symbol, round(regr_slope(ret, bench), 6) AS beta, round(regr_intercept(ret, bench), 6) AS alpha, round(regr_r2(ret, bench), 6) AS r2 FROM r JOIN bench USING (date) WHERE ret IS NOT NULL GROUP BY symbol")
def beta_ols(spark, d):
    r = weekly_returns(spark, d)
    rows = r.filter("ret IS NOT NULL").join(benchmark(r), "date")
    return rows.groupBy("symbol").agg(R(F.regr_slope("ret", "bench"), 6).alias("beta"), R(F.regr_intercept("ret", "bench"), 6).alias("alpha"), R(F.regr_r2("ret", "bench"), 6).alias("r2"))


@query("vasicek_betas")
def vasicek_betas(spark, d):
    r = weekly_returns(spark, d)
    return floats(V.vasicek(E.betas(r, benchmark(r)).select("symbol", "beta", "se")))


@query("factor_regression")
def factor_regression(spark, d):
    r = weekly_returns(spark, d)
    by = r.join(universe(spark, d).select("symbol", "region"), "symbol").filter("ret IS NOT NULL")
    f = by.groupBy("date").pivot("region", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]).agg(F.avg("ret")).na.fill(0.0)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
    return floats(E.factor_regression(r.join(f, "date"), names, dict.fromkeys(names, 0.06)).drop("loadings"))


@query("bvar_macro_paths")
def bvar_macro_paths(spark, d):
    q = quarters(spark, d).withColumn("growth", P.pct_change("sales", P.over("country"))).withColumn("orders", P.pct_change("n", P.over("country"))).filter("growth IS NOT NULL")
    return floats(X.macro_paths(q, ["growth", "orders"], sims=400))


@query("optimal_allocations")
def optimal_allocations(spark, d):
    r = weekly_returns(spark, d)
    labels = universe(spark, d).select("symbol", F.col("region").alias("label"))
    return floats(O.allocations(spark, r, benchmark(r), blends=tuple(O.BLENDS), labels=labels), 4)


@query("price_paths")
def price_paths(spark, d):
    return floats(X.return_paths(weekly(spark, d), 26, 200), 4)


@query("volatility_models")
def volatility_models(spark, d):
    return floats(X.volatility_models(weekly_returns(spark, d)), 4)


@query("trend_forecasts")
def trend_forecasts(spark, d):
    return floats(X.trend_forecasts(weekly(spark, d)), 4)


@query("return_regressions")
def return_regressions(spark, d):
    r = weekly_returns(spark, d)
    w = P.over("symbol")
    panel = r.select("symbol", "date", F.lead("ret").over(w).alias("target"), "ret", F.lag("ret").over(w).alias("l1"), P.rolling(F.stddev_samp, "ret", w, 8).alias("vol"))
    return floats(X.return_regressions(panel, ["ret", "l1", "vol"], 10), 4)


@query("gbm_scenarios")
def gbm_scenarios(spark, d):
    r = weekly_returns(spark, d)
    p = r.groupBy("symbol").agg((F.avg("ret") * 52).alias("mu"), (F.stddev_samp("ret") * 7.2).alias("sigma"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt")).withColumn("price", F.lit(100.0))
    return floats(X.gbm_terminal(spark, p, 4000), 4)


@query("dividend_yields")
def dividend_yields(spark, d):
    p = inputs(spark, d).select("symbol", "price", F.col("eps_low_y").alias("eps_low"), F.col("eps_avg_y").alias("eps_avg"), F.col("eps_high_y").alias("eps_high"), "payout", F.lit(0.1).alias("payout_sd"))
    return floats(X.dividend_yields(p.filter("eps_high > eps_low")))


@query("correlation_neighbours", f"WITH {RETS}, c AS (SELECT x.symbol AS src, y.symbol AS dst, corr(x.ret, y.ret) AS rho, count(*) AS n FROM r x JOIN r y ON x.date = y.date AND x.symbol <> y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM c WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY src ORDER BY abs(rho) DESC, dst) <= 5) SELECT src, dst, round(rho, 6) AS rho, round(abs(rho) / sum(abs(rho)) OVER (PARTITION BY src), 6) AS weight FROM t")
def correlation_neighbours(spark, d):
    return floats(X.neighbours(weekly_returns(spark, d)))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY ALL")
def event_windows(spark, d):
    return S.tumbling(parquet(spark, d, "events")).select("start", "event_type", "n", R("total", 4).alias("total"), "top")


@query("event_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    return S.sessions(parquet(spark, d, "events")).select("user_id", "start", "n", R("total", 4).alias("total"))


@query("event_sliding", "WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, value FROM events) SELECT start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY start")
def event_sliding(spark, d):
    return S.sliding(parquet(spark, d, "events")).select("start", "n", R("mean", 6).alias("mean"))


@query("shrinkage_covariance")
def shrinkage_covariance(spark, d):
    return floats(E.shrunk_covariances(weekly_returns(spark, d).filter("ret IS NOT NULL")), 8)


@query("factor_monte_carlo")
def factor_monte_carlo(spark, d):
    r = weekly_returns(spark, d)
    by = r.join(universe(spark, d).select("symbol", "region"), "symbol").filter("ret IS NOT NULL")
    f = by.groupBy("date").pivot("region", ["AFRICA", "ASIA"]).agg(F.avg("ret")).na.fill(0.0)
    return floats(E.factor_monte_carlo(r.join(f, "date"), ["AFRICA", "ASIA"], sims=300), 4)


@query("direct_quantiles")
def direct_quantiles(spark, d):
    from quantloom.operators import align as A

    w = P.over("symbol")
    r = weekly_returns(spark, d)
    panel = r.select("symbol", "date", "ret", F.lag("ret").over(w).alias("l1"), A.forward_sum("ret", 4).alias("target"))
    return floats(X.direct_quantiles(panel, ["ret", "l1"]), 4)


@query("peer_features", f"""WITH {RETS}, {UNIVERSE_SQL}, j AS (SELECT r.*, region FROM r JOIN universe USING (symbol)), l AS (SELECT *, sum(ret) OVER (PARTITION BY date) AS t1, count(ret) OVER (PARTITION BY date) AS n1, sum(ret) OVER (PARTITION BY region, date) AS t2, count(ret) OVER (PARTITION BY region, date) AS n2, (ret IS NOT NULL)::INT AS own FROM j), m AS (SELECT symbol, date, ret, CASE WHEN n1 > own THEN (t1 - coalesce(ret, 0)) / (n1 - own) END AS market, CASE WHEN n2 > own THEN (t2 - coalesce(ret, 0)) / (n2 - own) END AS grp FROM l),
c AS (SELECT x.symbol AS src, y.symbol AS dst, corr(x.ret, y.ret) AS rho, count(*) AS n FROM r x JOIN r y ON x.date = y.date AND x.symbol <> y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL), t AS (SELECT src, dst FROM c WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY src ORDER BY abs(rho) DESC, dst) <= 5), p AS (SELECT src AS symbol, r.date, avg(r.ret) AS peers FROM t JOIN r ON r.symbol = t.dst GROUP BY ALL)
SELECT m.symbol, m.date, round(m.ret, 6) AS ret, round(lag(market) OVER w, 6) AS market_l1, round(lag(grp) OVER w, 6) AS group_mean_l1, round(lag(peers) OVER w, 6) AS peers_l1 FROM m LEFT JOIN p ON p.symbol = m.symbol AND p.date = m.date WINDOW w AS (PARTITION BY m.symbol ORDER BY m.date)""")
def peer_features(spark, d):
    g = universe(spark, d).select("symbol", F.col("region").alias("grp"))
    return floats(X.peer_features(weekly_returns(spark, d), g))


@query("joint_paths")
def joint_paths(spark, d):
    return floats(X.joint_paths(weekly_returns(spark, d).filter("ret IS NOT NULL"), sims=2000, most_assets=2000), 4)

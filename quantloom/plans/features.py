"""Queries over the inputs of forecasting models, with DuckDB oracles but for the seeded and iterative ones."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import features as M
from quantloom.operators import indicators as I
from quantloom.plans.companies import ST_SQL, statements
from quantloom.plans.fundamentals import INPUT_SQL, inputs
from quantloom.plans.models import floats
from quantloom.plans.performance import BENCH, RETS, benchmark, weekly_returns
from quantloom.plans.technical import EWM, MIN, NUM, ROLL, WIN, R
from quantloom.sources.tables import BARS_SQL, UNIVERSE_SQL, bars, parquet, universe

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


KINDS = {"revenue": "dlog", "net_income": "slog", "debt": "diff", "ocf": "level"}
LOGGED = lambda x: f"ln(greatest({x}, 1e-6))"
SIGNED = lambda x: f"sign({x}) * ln(1 + abs({x}))"
STEP = lambda f, x: f"{f(x)} - {f(f'lag({x}) {WIN}')}"
DELTAS = f"{ST_SQL}, dl AS (SELECT symbol, date, {STEP(LOGGED, 'revenue')} AS revenue, {STEP(SIGNED, 'net_income')} AS net_income, debt - lag(debt) {WIN} AS debt, ocf FROM st QUALIFY row_number() {WIN} > 1)"
COLS = ("revenue", "net_income", "debt")
SCALES = f"{DELTAS}, sc AS (SELECT symbol, " + ", ".join(f"median({c}) AS {c}_median, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 ELSE greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 1e-6) END AS {c}_scale, quantile_cont({c}, 0.01) AS {c}_low, quantile_cont({c}, 0.99) AS {c}_high" for c in COLS) + " FROM dl GROUP BY symbol)"


def steps(spark, d):
    return M.deltas(statements(spark, d), KINDS)


@query("regressor_deltas", f"WITH {DELTAS} SELECT symbol, date, round(revenue, 6) AS revenue, round(net_income, 6) AS net_income, round(debt, 2) AS debt, round(ocf, 2) AS ocf FROM dl")
def regressor_deltas(spark, d):
    return steps(spark, d).select("symbol", "date", R("revenue", 6).alias("revenue"), R("net_income", 6).alias("net_income"), R("debt", 2).alias("debt"), R("ocf", 2).alias("ocf"))


@query("delta_scales", f"WITH {SCALES} SELECT symbol, " + ", ".join(f"round({c}_{s}, 4) AS {c}_{s}" for c in COLS for s in ("median", "scale", "low", "high")) + " FROM sc")
def delta_scales(spark, d):
    return floats(M.robust_scales(steps(spark, d), list(COLS)), 4)


@query("scaled_deltas", f"WITH {SCALES} SELECT symbol, date, " + ", ".join(f"round(least(greatest((least(greatest({c}, {c}_low), {c}_high) - {c}_median) / {c}_scale, -8), 8), 6) AS {c}" for c in COLS) + " FROM dl JOIN sc USING (symbol)")
def scaled_deltas(spark, d):
    rows = steps(spark, d)
    return floats(M.robustly_scaled(rows, M.robust_scales(rows, list(COLS)), list(COLS)).drop("ocf"))


@query("exogenous_design", f"WITH {RETS}, x AS (SELECT symbol, date, " + ", ".join(f"lag(ret, {n}) {WIN} AS ret_L{n}" for n in M.LAGS) + ", " + ", ".join(f"{f}((row_number() {WIN} - 1) * {2 * math.pi * j / 52!r}) AS fourier_{f}{j}" for j in (1, 2) for f in ("sin", "cos")) + " FROM r) SELECT symbol, date, " + ", ".join(f"round(ret_L{n}, 6) AS ret_L{n}" for n in M.LAGS) + ", " + ", ".join(f"round(fourier_{f}{j}, 6) AS fourier_{f}{j}" for j in (1, 2) for f in ("sin", "cos")) + " FROM x WHERE ret_L1 IS NOT NULL AND ret_L2 IS NOT NULL AND ret_L3 IS NOT NULL")
def exogenous_design(spark, d):
    return floats(M.lagged_design(weekly_returns(spark, d), ["ret"]))


@query("ar1_baselines", f"WITH {RETS}, p AS (SELECT symbol, date, ret AS y, lag(ret) {WIN} AS x FROM r WHERE ret IS NOT NULL), a AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS c, avg(CASE WHEN x IS NOT NULL THEN y END) AS m, arg_max(y, date) AS last FROM p GROUP BY symbol), f AS (SELECT symbol, n, last, CASE WHEN n < 3 THEN 0 ELSE coalesce(b, 0) END AS phi, CASE WHEN n < 3 THEN 0 WHEN b IS NULL THEN m WHEN abs(1 - b) <= 1e-8 THEN 0 ELSE c / (1 - b) END AS mean FROM a) SELECT symbol, n, round(mean, 6) AS mean, round(phi, 6) AS phi, round(last, 6) AS last, round(52 * mean + CASE WHEN abs(1 - phi) < 1e-8 THEN 0 ELSE (last - mean) * phi * (1 - pow(phi, 52)) / (1 - phi) END, 6) AS expected_sum FROM f")
def ar1_baselines(spark, d):
    return floats(M.ar1_baselines(weekly_returns(spark, d)))


MOVE = lambda s, t: f"count(*) FILTER (nxt IS NOT NULL AND before = {s} AND jump = {t})"
SHARE = lambda s, t: f"round({MOVE(s, t)} / greatest({MOVE(s, 0)} + {MOVE(s, 1)}, 1), 6) AS p{s}{t}"


@query("jump_states", f"WITH {RETS}, q AS (SELECT symbol, date, abs(ret) AS size, quantile_cont(abs(ret), 0.97) OVER (PARTITION BY symbol) AS threshold, quantile_cont(abs(ret), 0.95) OVER (PARTITION BY symbol) AS cutoff FROM r WHERE ret IS NOT NULL), j AS (SELECT *, CASE WHEN size >= threshold THEN 1 ELSE 0 END AS jump FROM q), b AS (SELECT *, lag(jump, 1, 0) {WIN} AS before, lead(jump) {WIN} AS nxt FROM j) SELECT symbol, round(min(threshold), 6) AS threshold, round(min(cutoff), 6) AS cutoff, {SHARE(0, 0)}, {SHARE(0, 1)}, {SHARE(1, 0)}, {SHARE(1, 1)}, " + ", ".join(f"round(least(greatest(coalesce(avg(jump) FILTER (before = {s}), 0.01), 1e-4), 0.5), 6) AS emit{s}" for s in (0, 1)) + ", count(*) FILTER (size >= cutoff) AS n_tail, round(avg(size - cutoff) FILTER (size >= cutoff), 6) AS mean_excess FROM b GROUP BY symbol")
def jump_states(spark, d):
    return floats(M.jump_states(M.jump_flags(weekly_returns(spark, d))))


@query("jump_intensity")
def jump_intensity(spark, d):
    return floats(M.jump_intensity(M.jump_flags(weekly_returns(spark, d))), 4)


KIND = lambda x: f"count({x}) AS n, coalesce(avg(CASE WHEN abs({x}) <= 0.5 THEN 1.0 WHEN {x} IS NOT NULL THEN 0.0 END) > 0.9 AND avg(CASE WHEN abs({x}) <= 2 THEN 1.0 WHEN {x} IS NOT NULL THEN 0.0 END) > 0.99, true) AS is_returns"


@query("series_kinds", f"WITH {RETS} SELECT symbol, 'ret' AS series, {KIND('ret')} FROM r GROUP BY symbol UNION ALL SELECT symbol, 'close' AS series, {KIND('close')} FROM wk GROUP BY symbol")
def series_kinds(spark, d):
    weeks = P.resample(bars(spark, d), "W-SUN", {"close": "last"})
    of = lambda df, x: M.looks_like_returns(df, x).select("symbol", F.lit(x).alias("series"), "n", "is_returns")
    return of(weekly_returns(spark, d), "ret").unionByName(of(weeks, "close"))


GAPS = f"{BARS_SQL}, g AS (SELECT symbol, date, CASE WHEN day(date) % 7 <> 0 THEN close END AS close FROM bars), l AS (SELECT symbol, date, coalesce(last_value(close IGNORE NULLS) {WIN}, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM g)"


def gappy(spark, d):
    return bars(spark, d).select("symbol", "date", F.when(F.dayofmonth("date") % 7 != 0, F.col("close")).alias("close"))


@query("index_quarter_returns", f"WITH {GAPS}, q AS (SELECT symbol, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS date, arg_max(close, date) AS close FROM l GROUP BY ALL), r AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM q) SELECT symbol, date, round(ret, 6) AS ret FROM r WHERE ret IS NOT NULL")
def index_quarter_returns(spark, d):
    return floats(M.index_panel(gappy(spark, d))[1])


@query("index_week_returns", f"WITH {GAPS}, q AS (SELECT symbol, CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) AS date, arg_max(close, date) AS close FROM l GROUP BY ALL), r AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM q) SELECT symbol, date, round(ret, 6) AS ret FROM r WHERE ret IS NOT NULL")
def index_week_returns(spark, d):
    return floats(M.index_panel(gappy(spark, d))[0])


@query("index_long_returns", f"WITH {GAPS} SELECT symbol, round(pow(arg_max(close, date) / arg_min(close, date), 0.2) - 1, 6) AS ann_return FROM l GROUP BY symbol")
def index_long_returns(spark, d):
    return floats(M.index_panel(gappy(spark, d))[2])


EXCHANGES = [*M.INDEX_OF_EXCHANGE, "Elsewhere"]
INDEXES = ["^NDX", "^FTSE", "^GDAXI", "^FCHI", "^HSI"]
NAMES = lambda values: f"[{', '.join(map(repr, values))}]"


@query("index_matches", f"WITH l AS (SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 11 <> 0 THEN ({NAMES(EXCHANGES)})[1 + s_suppkey % {len(EXCHANGES)}] END AS exchange FROM supplier), i AS (SELECT *, CASE exchange {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in M.INDEX_OF_EXCHANGE.items())} ELSE '^GSPC' END AS index FROM l), o AS (SELECT ({NAMES(INDEXES)})[1 + r_regionkey] AS index, r_regionkey / 10 AS ann_return, r_regionkey % 2 = 1 AS over FROM region) SELECT symbol, exchange, i.index, round(coalesce(CASE WHEN over THEN 1 - ann_return END, ann_return, 0), 6) AS index_return FROM i LEFT JOIN o ON i.index = o.index")
def index_matches(spark, d):
    at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + k).cast("int"))
    k = F.col("s_suppkey")
    listed = parquet(spark, d, "supplier").select(k.alias("symbol"), F.when(k % 11 != 0, at(EXCHANGES, k % len(EXCHANGES))).alias("exchange"))
    own = parquet(spark, d, "region").select(at(INDEXES, F.col("r_regionkey")).alias("index"), (F.col("r_regionkey") / 10).alias("ann_return"), "r_regionkey")
    return floats(M.matched_index(listed, own, own.filter("r_regionkey % 2 = 1").withColumn("ann_return", 1 - F.col("ann_return"))))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("currency_factors", f"WITH {BARS_SQL}, {UNIVERSE_SQL}, x AS (SELECT region AS ccy, date, avg(close) AS rate FROM bars JOIN universe USING (symbol) GROUP BY ALL), w AS (SELECT ccy, CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) AS date, arg_max(rate, date) AS rate FROM x GROUP BY ALL), f AS (SELECT ccy, date, rate / lag(rate) OVER (PARTITION BY ccy ORDER BY date) - 1 AS ret FROM w) SELECT date, " + ", ".join(f"round(max(ret) FILTER (ccy = {c!r}), 6) AS \"FX_{c}\"" for c in REGIONS if c != "AMERICA") + " FROM f GROUP BY date")
def currency_factors(spark, d):
    by = bars(spark, d).join(universe(spark, d).select("symbol", F.col("region").alias("ccy")), "symbol")
    return floats(M.currency_factors(by.groupBy("ccy", "date").agg(F.avg("close").alias("rate")), list(REGIONS), "AMERICA"))


@query("external_alphas", f"WITH {RETS}, {BENCH}, e AS (SELECT symbol, avg(ret) * 52 AS expected FROM r GROUP BY symbol), b AS (SELECT symbol, regr_slope(ret, bench) AS beta FROM r JOIN bench USING (date) WHERE ret IS NOT NULL AND symbol % 5 <> 0 GROUP BY symbol), j AS (SELECT symbol, expected, coalesce(beta, 1.0) AS beta FROM e LEFT JOIN b USING (symbol)) SELECT symbol, round(expected, 6) AS expected, round(beta, 6) AS beta, round(expected - beta * 0.07 - (1 - beta) * 0.03, 6) AS alpha FROM j")
def external_alphas(spark, d):
    r = weekly_returns(spark, d)
    betas = r.filter("ret IS NOT NULL AND symbol % 5 <> 0").join(benchmark(r), "date").groupBy("symbol").agg(F.regr_slope("ret", "bench").alias("beta"))
    return floats(M.external_alpha(r.groupBy("symbol").agg((F.avg("ret") * 52).alias("expected")), betas, 0.07, 0.03, excess=False))


@query("working_capital_slopes", f"WITH {ST_SQL}, w AS (SELECT symbol, date, revenue, current_assets - current_liabilities AS wc FROM st), s AS (SELECT symbol, (wc - lag(wc) {WIN}) / nullif(revenue - lag(revenue) {WIN}, 0) AS s FROM w) SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 4 THEN round(least(greatest(median(s), -0.4), 0.4), 6) END AS slope FROM s GROUP BY symbol")
def working_capital_slopes(spark, d):
    return floats(M.working_capital_slopes(statements(spark, d).withColumn("working_capital", F.col("current_assets") - F.col("current_liabilities"))))


@query("count_quantiles", "SELECT p_partkey, p_size AS n, round(([" + ", ".join(f"{NormalDist().inv_cdf(1 - 1 / max(n, 3))!r}::DOUBLE" for n in range(1, 51)) + "])[p_size], 6) AS z FROM part")
def count_quantiles(spark, d):
    return parquet(spark, d, "part").select("p_partkey", F.col("p_size").alias("n"), R(M.count_z(F.col("p_size")), 6).alias("z"))


LABELS = ("low_y", "avg_y", "high_y")
PAIRS = lambda p: "[" + ", ".join(f"{{'label': {k!r}, 'value': {p}_{k}::DOUBLE}}" for k in LABELS) + "]"


@query("scenario_rows", f"WITH {INPUT_SQL}, x AS (SELECT symbol, coe, g, unnest({PAIRS('rev')}) AS r, {PAIRS('eps')} AS es FROM inputs), y AS (SELECT symbol, coe, g, r, unnest(es) AS e FROM x) SELECT symbol, r.label || '_rev__' || e.label || '_eps' AS scenario, round(r.value, 6) AS revenue_growth, round(e.value, 6) AS eps_growth, round(coe, 6) AS coe, round(g, 6) AS g FROM y")
def scenario_rows(spark, d):
    named = lambda p: {k: f"{p}_{k}" for k in LABELS}
    used = [c for p in ("rev", "eps") for c in named(p).values()]
    return floats(M.scenario_rows(inputs(spark, d).select("symbol", *used, "coe", "g"), named("rev"), named("eps")))


@query("aligned_scenarios", f"WITH {INPUT_SQL}, m AS (SELECT median(eps_avg) AS a, median(pe2) AS b, median(bvps) AS c FROM inputs) SELECT symbol, round(coalesce(eps_avg, a), 6) AS eps_avg, round(coalesce(pe2, b), 6) AS pe2, round(c, 6) AS bvps FROM inputs, m")
def aligned_scenarios(spark, d):
    rows = inputs(spark, d)
    return floats(M.aligned_to_training(rows.select("symbol", "eps_avg", "pe2"), rows, ["eps_avg", "pe2", "bvps"], ["symbol"]))


@query("prices_of_returns", f"WITH {RETS}, {INPUT_SQL} SELECT symbol, date, round(price * exp(sum(coalesce(ln(1 + ret), 0)) {WIN}), 4) AS price FROM r JOIN inputs USING (symbol)")
def prices_of_returns(spark, d):
    r = weekly_returns(spark, d).select("symbol", "date", F.log1p("ret").alias("log_ret"))
    return M.prices_of_returns(r, inputs(spark, d)).select("symbol", "date", R("price", 4).alias("price"))


@query("pert_modes", f"WITH {INPUT_SQL} SELECT symbol, round(CASE WHEN eps_avg IS NULL THEN NULL WHEN eps_low < eps_avg AND eps_avg < eps_high THEN eps_avg ELSE least(greatest(eps_avg, eps_low + 1e-8), eps_high - 1e-8) END, 9) AS mode FROM inputs")
def pert_modes(spark, d):
    return inputs(spark, d).select("symbol", R(M.pert_mode(F.col("eps_low"), F.col("eps_avg"), F.col("eps_high")), 9).alias("mode"))


BEFORE = lambda agg: f"CASE WHEN count(ret) {ROLL(26, 1)} >= 8 THEN {agg}(ret) {ROLL(26, 1)} END"
COVER = lambda a: f"avg(CASE WHEN abs(ret - mu) <= least(10.0, sigma * s) * {M.t_quantile(1 - a / 2, None)!r}e0 THEN 1e0 ELSE 0e0 END) - {1 - a!r}e0"


@query("spread_scales", f"WITH {RETS}, v AS (SELECT symbol, ret, {BEFORE('avg')} AS mu, {BEFORE('stddev_samp')} AS sigma FROM r), c AS (SELECT symbol, s, count(*) AS n, {', '.join(f'{COVER(a)} AS e{i}' for i, a in enumerate(M.TAIL_MASSES))} FROM v, (SELECT unnest([{', '.join(f'{x!r}e0' for x in M.SPREAD_SCALES)}]) AS s) WHERE ret IS NOT NULL AND mu IS NOT NULL AND sigma IS NOT NULL GROUP BY symbol, s), l AS (SELECT symbol, n, s AS scale, (e0 * e0 + e1 * e1 + e2 * e2) / 3 AS loss FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY (e0 * e0 + e1 * e1 + e2 * e2) / 3, s) = 1) SELECT symbol, n, round(scale, 6) AS scale, round(loss, 6) AS loss FROM l")
def spread_scales(spark, d):
    w = P.over("symbol")
    rows = weekly_returns(spark, d).select("symbol", "date", "ret", P.rolling(F.avg, "ret", w, 26, 8, shift=1).alias("mu"), P.rolling(F.stddev_samp, "ret", w, 26, 8, shift=1).alias("sigma"))
    return floats(M.spread_scales(rows, "ret", "mu", "sigma"))


RULES = {
    "rsi": ("rsi", "rsi < 30 OR rsi > 70"),
    "mfi": ("mfi", "mfi < 20 OR mfi > 80"),
    "bb": ("(close - mid) / nullif(sd, 0)", "abs((close - mid) / nullif(sd, 0)) >= 2"),
    "atr": ("atr", "close > hi + 1.5 * a1 OR close < lo - 1.5 * a1"),
    "stoch": ("k", "k < 20 OR k > 80"),
    "ema": ("ema", "ema <> 0"),
    "macd": ("macd", "macd <> 0"),
    "vwap": ("close - vwap", "close - vwap <> 0"),
    "obv": ("obv", "(close < cl AND obv >= ol) OR (close > ch AND obv <= oh)"),
}
FLOW = lambda sign: f"CASE WHEN tp {sign} lag(tp) {WIN} THEN tp * volume ELSE 0 END"
LIVE = f"""{BARS_SQL}, {NUM}, f AS {EWM('r', 'close', '(2.0/13)')}, s AS {EWM('r', 'close', '(2.0/27)')}, m AS (SELECT f.symbol, f.date, f.n, f.v - s.v AS m FROM f JOIN s USING (symbol, date)), g AS {EWM('m', 'm', '0.2')}, u AS {EWM('r', 'up', '(1.0/14)')}, z AS {EWM('r', 'dn', '(1.0/14)')},
t1 AS (SELECT *, coalesce(sign(close - lag(close) {WIN}), 0) * volume AS st, greatest(high - low, abs(high - lag(close) {WIN}), abs(low - lag(close) {WIN})) AS tr, (high + low + close) / 3 AS tp, (high + low + close) / 3 * volume AS pv FROM bars),
t2 AS (SELECT *, sum(st) {WIN} AS obv, {MIN('avg', 'tr', 14)} AS atr, {MIN('avg', 'close', 20)} AS mid, {MIN('stddev_pop', 'close', 20)} AS sd, 100 * (close - {MIN('min', 'low', 14)}) / nullif({MIN('max', 'high', 14)} - {MIN('min', 'low', 14)}, 0) AS k, {FLOW('>')} AS fu, {FLOW('<')} AS fd, {MIN('max', 'high', 20, 1)} AS hi, {MIN('min', 'low', 20, 1)} AS lo, {MIN('max', 'close', 20, 1)} AS ch, {MIN('min', 'close', 20, 1)} AS cl, {MIN('sum', 'pv', 20)} / nullif({MIN('sum', 'volume', 20)}, 0) AS vwap FROM t1),
t3 AS (SELECT *, 100 - 100 / (1 + {MIN('sum', 'fu', 14)} / nullif({MIN('sum', 'fd', 14)}, 0)) AS mfi, lag(atr) {WIN} AS a1, {MIN('max', 'obv', 20, 1)} AS oh, {MIN('min', 'obv', 20, 1)} AS ol FROM t2),
x AS (SELECT t3.*, m.m AS ema, m.m - g.v AS macd, CASE WHEN u.n < 14 THEN NULL WHEN z.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / z.v) END AS rsi FROM t3 JOIN m USING (symbol, date) JOIN g USING (symbol, date) JOIN u USING (symbol, date) JOIN z USING (symbol, date)),
lv AS ({' UNION ALL '.join(f'SELECT symbol, date, {name!r} AS indicator, ({value})::DOUBLE AS value, coalesce({on}, false) AS live FROM x' for name, (value, on) in RULES.items())})"""


@query("live_indicators", f"WITH {LIVE} SELECT symbol, indicator, round(arg_max(value, date) FILTER (value IS NOT NULL), 4) AS value, arg_max(live, date) FILTER (value IS NOT NULL) AS live, count(*) FILTER (live) AS n_live FROM lv GROUP BY symbol, indicator")
def live_indicators(spark, d):
    return floats(M.last_levels(M.live_levels(I.precompute(bars(spark, d)))), 4)


@query("terminal_growth")
def terminal_growth(spark, d):
    s = statements(spark, d)
    payouts = s.groupBy("symbol").agg(F.first(F.when(F.col("symbol") % 5 != 0, (F.col("symbol") % 4) / 4)).alias("payout")).withColumn("payout_sd", F.lit(0.1))
    return floats(M.terminal_growth(s.select("symbol", "date", (F.col("net_income") / (0.4 * F.col("assets"))).alias("roe")), payouts), 4)

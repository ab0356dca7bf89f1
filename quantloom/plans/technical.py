"""Queries over daily bars: panel primitives, indicators, rules and calibration, with DuckDB oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import indicators as I
from quantloom.sources.tables import BARS_SQL, bars

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {BARS_SQL} {sql}"
        return fn

    return add


def R(x, n: int = 6):
    """floor(x 10^n + 0.501) / 10^n: the same doubles in both engines. Prices over small quantities often end on a decimal tie,
    where the last bit of a sum would decide; the thousandth of a unit takes them up."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < 1e12, F.floor(x * 10.0**n + 0.501).cast("double") / 10.0**n).otherwise(x)


def plain_rounding(sql: str) -> str:
    """round(x, n) written out the same way."""
    at = 0
    while m := re.compile(r"(?<![A-Za-z_])round\(").search(sql, at):
        depth, i, comma = 1, m.end(), None
        while depth:
            depth += (sql[i] in "([") - (sql[i] in ")]")
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        x, n = sql[m.end() : comma], int(sql[comma + 1 : i - 1])
        sql = f"{sql[: m.start()]}(CASE WHEN abs({x}) < 1e12 THEN floor(({x}) * 1e{n} + 0.501) / 1e{n} ELSE {x} END){sql[i:]}"
        at = m.start()
    return sql


def rounded(df, *cols, n=6):
    return df.select(*[R(c, n).alias(c) if c in cols else c for c in df.columns])


WIN = "OVER (PARTITION BY symbol ORDER BY date)"
ROLL = lambda n, s=0: f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 + s} PRECEDING AND {s} {'PRECEDING' if s else 'FOLLOWING'})"
MIN = lambda agg, x, n, s=0: f"CASE WHEN count({x}) {ROLL(n, s)} >= {n} THEN {agg}({x}) {ROLL(n, s)} END"


@query("bars_daily", "SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def bars_daily(spark, d):
    return rounded(bars(spark, d), "open", "high", "low", "close")


@query("returns_panel", f"SELECT symbol, date, round(close / lag(close) {WIN} - 1, 6) AS ret, round(ln(close / lag(close) {WIN}), 6) AS log_ret, round(close - lag(close, 5) {WIN}, 6) AS diff5, round(close / lead(close) {WIN} - 1, 6) AS lead_ret FROM bars")
def returns_panel(spark, d):
    w = I.W()
    return bars(spark, d).select("symbol", "date", R(P.pct_change("close", w), 6).alias("ret"), R(P.log_return("close", w), 6).alias("log_ret"), R(P.diff("close", w, 5), 6).alias("diff5"), R(P.ratio(F.col("close"), F.lead("close").over(w)) - 1, 6).alias("lead_ret"))


@query("rolling_stats", f"SELECT symbol, date, round({MIN('avg', 'close', 20)}, 6) AS sma20, round({MIN('stddev_samp', 'close', 20)}, 6) AS sd20, round({MIN('min', 'close', 20)}, 6) AS min20, round({MIN('max', 'close', 20)}, 6) AS max20, round({MIN('median', 'close', 20)}, 6) AS med20, round({MIN('sum', 'volume', 10)}, 4) AS vol10 FROM bars")
def rolling_stats(spark, d):
    w, r = I.W(), P.rolling
    return bars(spark, d).select("symbol", "date", R(r(F.avg, "close", w, 20), 6).alias("sma20"), R(r(F.stddev_samp, "close", w, 20), 6).alias("sd20"), R(r(F.min, "close", w, 20), 6).alias("min20"), R(r(F.max, "close", w, 20), 6).alias("max20"), R(r(lambda x: F.percentile(x, F.lit(0.5)), "close", w, 20), 6).alias("med20"), R(r(F.sum, "volume", w, 10), 4).alias("vol10"))


@query("cumulative", f"SELECT symbol, date, sum(volume) {WIN} AS cum_volume, round(max(close) {WIN}, 6) AS peak, round(close / max(close) {WIN} - 1, 6) AS drawdown FROM bars")
def cumulative(spark, d):
    w = I.W()
    return bars(spark, d).select("symbol", "date", P.cumsum(F.col("volume"), w).alias("cum_volume"), R(P.cummax(F.col("close"), w), 6).alias("peak"), R(F.col("close") / P.cummax(F.col("close"), w) - 1, 6).alias("drawdown"))


BB = f"""bb AS (SELECT *, {MIN('avg', 'close', 20)} AS mid, {MIN('stddev_pop', 'close', 20)} AS sd, lag(close) {WIN} AS c1 FROM bars),
sig AS (SELECT *, CASE WHEN close < mid + 2 * sd AND c1 >= mid + 2 * sd THEN -1 WHEN close > mid - 2 * sd AND c1 <= mid - 2 * sd THEN 1 END AS pulse FROM bb),
pos AS (SELECT *, coalesce(last_value(pulse IGNORE NULLS) {WIN}, 0) AS position FROM sig)"""


@query("bollinger_signal", f"WITH {BARS_SQL}, {BB} SELECT symbol, max(date) AS date, arg_max(position, date)::INTEGER AS position, count(pulse) AS n_pulses, round(arg_max(mid, date), 6) AS mid FROM pos GROUP BY symbol")
def bollinger_signal(spark, d):
    rows = I.bollinger(bars(spark, d))
    c1 = F.lag("close").over(I.W())
    rows = rows.withColumn("buy", F.coalesce((F.col("close") > F.col("bb_low")) & (c1 <= F.col("bb_low")), F.lit(False))).withColumn("sell", F.coalesce((F.col("close") < F.col("bb_high")) & (c1 >= F.col("bb_high")), F.lit(False)))
    rows = rows.withColumn("position", I.held(F.col("buy"), F.col("sell")))
    return rows.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("position", "date").alias("position"), F.count(F.when(F.col("buy") | F.col("sell"), 1)).alias("n_pulses"), R(F.max_by("bb_mid", "date"), 6).alias("mid"))


TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) {WIN}), abs(low - lag(close) {WIN})) AS tr FROM bars)"


@query("atr", f"WITH {BARS_SQL}, {TR} SELECT symbol, date, round(tr, 6) AS tr, round({MIN('avg', 'tr', 14)}, 6) AS atr FROM tr")
def atr(spark, d):
    return rounded(I.atr(bars(spark, d)).select("symbol", "date", "tr", "atr"), "tr", "atr")


@query("stochastic", f"WITH {BARS_SQL}, k AS (SELECT *, 100 * (close - {MIN('min', 'low', 14)}) / nullif({MIN('max', 'high', 14)} - {MIN('min', 'low', 14)}, 0) AS k FROM bars) SELECT symbol, date, round(k, 6) AS stoch_k, round({MIN('avg', 'k', 3)}, 6) AS stoch_d FROM k")
def stochastic(spark, d):
    return rounded(I.stochastic(bars(spark, d)).select("symbol", "date", "stoch_k", "stoch_d"), "stoch_k", "stoch_d")


OBV = f"s AS (SELECT *, coalesce(sign(close - lag(close) {WIN}), 0) * volume AS s FROM bars), obv AS (SELECT *, sum(s) {WIN} AS obv FROM s)"


@query("obv", f"WITH {BARS_SQL}, {OBV} SELECT symbol, date, obv FROM obv")
def obv(spark, d):
    return I.obv(bars(spark, d)).select("symbol", "date", "obv")


@query("mfi", f"WITH {BARS_SQL}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), f AS (SELECT *, CASE WHEN tp > lag(tp) {WIN} THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < lag(tp) {WIN} THEN tp * volume ELSE 0 END AS dn FROM t) SELECT symbol, date, round(100 - 100 / (1 + {MIN('sum', 'up', 14)} / nullif({MIN('sum', 'dn', 14)}, 0)), 6) AS mfi FROM f")
def mfi(spark, d):
    return rounded(I.mfi(bars(spark, d)).select("symbol", "date", "mfi"), "mfi")


@query("vwap", f"WITH {BARS_SQL}, t AS (SELECT *, (high + low + close) / 3 * volume AS pv FROM bars) SELECT symbol, date, round({MIN('sum', 'pv', 20)} / nullif({MIN('sum', 'volume', 20)}, 0), 6) AS vwap FROM t")
def vwap(spark, d):
    return rounded(I.vwap(bars(spark, d)).select("symbol", "date", "vwap"), "vwap")


@query("breakouts", f"WITH {BARS_SQL}, {OBV} SELECT symbol, date, round({MIN('max', 'high', 20, 1)}, 6) AS hi_prev, round({MIN('min', 'low', 20, 1)}, 6) AS lo_prev, {MIN('max', 'obv', 20, 1)} AS obv_hi_prev, {MIN('min', 'obv', 20, 1)} AS obv_lo_prev FROM obv")
def breakouts(spark, d):
    return rounded(I.breakouts(I.obv(bars(spark, d))).select("symbol", "date", "hi_prev", "lo_prev", "obv_hi_prev", "obv_lo_prev"), "hi_prev", "lo_prev")


@query("volume_gate", f"SELECT symbol, date, coalesce(volume >= {MIN('median', 'volume', 20)}, false) AS vol_ok FROM bars")
def volume_gate(spark, d):
    return bars(spark, d).select("symbol", "date", I.volume_ok().alias("vol_ok"))


EWM = lambda src, x, a: f"(SELECT b.symbol, b.date, b.n, sum(c.{x} * CASE WHEN c.n = 1 THEN pow(1 - {a}, b.n - 1) ELSE {a} * pow(1 - {a}, b.n - c.n) END) AS v FROM {src} b JOIN {src} c ON b.symbol = c.symbol AND c.n <= b.n GROUP BY ALL)"
NUM = f"r AS (SELECT *, row_number() {WIN} AS n, coalesce(greatest(close - lag(close) {WIN}, 0), 0) AS up, coalesce(greatest(lag(close) {WIN} - close, 0), 0) AS dn FROM bars)"


@query("ema", f"WITH {BARS_SQL}, {NUM}, f AS {EWM('r', 'close', '(2.0/13)')}, s AS {EWM('r', 'close', '(2.0/27)')} SELECT f.symbol, f.date, round(f.v, 4) AS ema_fast, round(s.v, 4) AS ema_slow, round(f.v - s.v, 4) AS macd FROM f JOIN s USING (symbol, date)")
def ema(spark, d):
    return rounded(I.exponential(bars(spark, d)).select("symbol", "date", "ema_fast", "ema_slow", "macd"), "ema_fast", "ema_slow", "macd", n=4)


@query("macd_signal", f"WITH {BARS_SQL}, {NUM}, f AS {EWM('r', 'close', '(2.0/13)')}, s AS {EWM('r', 'close', '(2.0/27)')}, m AS (SELECT f.symbol, f.date, f.n, f.v - s.v AS m FROM f JOIN s USING (symbol, date)), g AS {EWM('m', 'm', '0.2')} SELECT symbol, date, round(v, 4) AS macd_signal FROM g")
def macd_signal(spark, d):
    return rounded(I.exponential(bars(spark, d)).select("symbol", "date", "macd_signal"), "macd_signal", n=4)


@query("rsi", f"WITH {BARS_SQL}, {NUM}, u AS {EWM('r', 'up', '(1.0/14)')}, v AS {EWM('r', 'dn', '(1.0/14)')} SELECT u.symbol, u.date, CASE WHEN u.n < 14 THEN NULL WHEN v.v = 0 THEN 100 ELSE round(100 - 100 / (1 + u.v / v.v), 5) END AS rsi FROM u JOIN v USING (symbol, date)")
def rsi(spark, d):
    return rounded(I.exponential(bars(spark, d)).select("symbol", "date", "rsi"), "rsi", n=5)


#: Row by row: the state of each symbol after its bar n (a running mean keeps decaying over gaps).
ADX = f"""b0 AS (SELECT *, row_number() {WIN} AS n, greatest(high - low, abs(high - lag(close) {WIN}), abs(low - lag(close) {WIN})) AS tr, greatest(high - lag(high) {WIN}, 0) AS up, greatest(lag(low) {WIN} - low, 0) AS dn FROM bars),
b1 AS (SELECT symbol, date, n, tr, CASE WHEN up > dn THEN up ELSE 0 END AS plus, CASE WHEN dn > up THEN dn ELSE 0 END AS minus FROM b0),
s AS (SELECT symbol, date, n, tr::DOUBLE AS mtr, plus::DOUBLE AS mp, minus::DOUBLE AS mm FROM b1 WHERE n = 1 UNION ALL
  SELECT b.symbol, b.date, b.n, 13 / 14.0::DOUBLE * mtr + b.tr / 14, 13 / 14.0::DOUBLE * mp + b.plus / 14, 13 / 14.0::DOUBLE * mm + b.minus / 14 FROM s JOIN b1 b ON b.symbol = s.symbol AND b.n = s.n + 1),
x AS (SELECT symbol, date, n, 100 * abs(mp - mm) / nullif(mp + mm, 0) AS dx FROM s WHERE mtr <> 0 UNION ALL SELECT symbol, date, n, NULL FROM s WHERE mtr = 0),
a AS (SELECT symbol, date, n, dx AS adx, 1.0::DOUBLE AS w FROM x WHERE n = 1 UNION ALL
  SELECT x.symbol, x.date, x.n, CASE WHEN adx IS NULL THEN dx WHEN dx IS NULL THEN adx ELSE (w * 13 / 14 * adx + dx / 14) / (w * 13 / 14 + 1 / 14.0::DOUBLE) END, CASE WHEN adx IS NULL OR dx IS NOT NULL THEN 1 ELSE w * 13 / 14 END FROM a JOIN x ON x.symbol = a.symbol AND x.n = a.n + 1)"""


@query("adx", f"WITH RECURSIVE {BARS_SQL}, {ADX} SELECT symbol, date, round(adx, 5) AS adx FROM a")
def adx(spark, d):
    return rounded(I.exponential(bars(spark, d)).select("symbol", "date", "adx"), "adx", n=5)


@query("indicator_scores")
def indicator_scores(spark, d):
    rows = I.score(I.positions(I.precompute(bars(spark, d))))
    last = P.keep_last(rows, ["symbol"], [F.col("date")])
    return last.select("symbol", "date", *[f"pos_{n}" for n in I.NAMES], "score")


STATS = lambda keys: f"""e AS (SELECT *, lag(position) OVER (PARTITION BY {keys} ORDER BY date) AS p FROM p0),
st AS (SELECT {keys}, count(*) AS n, avg(p * ret) AS mean, stddev_samp(p * ret) AS sd FROM e WHERE p IS NOT NULL AND ret IS NOT NULL GROUP BY ALL)"""  # noqa: E731


@query("bollinger_backtest", f"WITH {BARS_SQL}, {BB}, p0 AS (SELECT *, close / lag(close) {WIN} - 1 AS ret FROM pos), {STATS('symbol')} SELECT symbol, n, round(CASE WHEN sd > 0 THEN sqrt(252.0) * mean / sd END, 6) AS sharpe, round(CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) ELSE 0 END, 6) AS t_stat FROM st")
def bollinger_backtest(spark, d):
    rows = I.bollinger(bars(spark, d)).withColumn("ret", P.pct_change("close", I.W()))
    c1 = F.lag("close").over(I.W())
    buy, sell = (F.col("close") > F.col("bb_low")) & (c1 <= F.col("bb_low")), (F.col("close") < F.col("bb_high")) & (c1 >= F.col("bb_high"))
    rows = rows.withColumn("_b", F.coalesce(buy, F.lit(False))).withColumn("_s", F.coalesce(sell, F.lit(False)))
    rows = rows.withColumn("position", I.held(F.col("_b"), F.col("_s")))
    return rounded(I.stats(rows, "position", ["symbol"]).select("symbol", "n", "sharpe", "t_stat"), "sharpe", "t_stat")


@query("cooldown_positions", f"""WITH RECURSIVE {BARS_SQL}, bb AS (SELECT symbol, date, close, row_number() {WIN} AS n, {MIN('avg', 'close', 10)} AS mid, {MIN('stddev_pop', 'close', 10)} AS sd FROM bars),
p AS (SELECT symbol, date, n, coalesce(close < mid - sd, false) AS b, coalesce(close > mid + sd, false) AS s FROM bb), l AS (SELECT *, coalesce(lag(b) {WIN}, false) AS b1, coalesce(lag(s) {WIN}, false) AS s1 FROM p),
q AS (SELECT symbol, date, n, b, s, 0 AS position, 0 AS wait FROM l WHERE n = 1 UNION ALL
  SELECT l.symbol, l.date, l.n, l.b, l.s, CASE WHEN wait = 0 AND s1 THEN -1 WHEN wait = 0 AND b1 THEN 1 ELSE position END, CASE WHEN wait = 0 AND (s1 OR b1) THEN 3 ELSE greatest(wait - 1, 0) END FROM q JOIN l ON l.symbol = q.symbol AND l.n = q.n + 1)
SELECT symbol, date, b, s, position FROM q""")
def cooldown_positions(spark, d):
    rows = I.bollinger(bars(spark, d), 10, 1.0)
    rows = rows.select("symbol", "date", F.coalesce(F.col("close") < F.col("bb_low"), F.lit(False)).alias("b"), F.coalesce(F.col("close") > F.col("bb_high"), F.lit(False)).alias("s"))
    return I.with_cooldown(rows, "b", "s", lag=1, cooldown=3)


@query("liquidity", f"WITH {BARS_SQL}, v AS (SELECT *, close * volume AS dv FROM bars), a AS (SELECT symbol, date, CASE WHEN count(dv) {ROLL(20)} >= 12 THEN avg(dv) {ROLL(20)} END AS adv FROM v) SELECT symbol, round(arg_max(adv, date), 4) AS adv FROM a GROUP BY symbol")
def liquidity(spark, d):
    return rounded(I.liquidity(bars(spark, d)), "adv", n=4)


@query("amihud", f"WITH {BARS_SQL}, v AS (SELECT *, abs(close / lag(close) {WIN} - 1) / nullif(close * volume, 0) AS x FROM bars), a AS (SELECT symbol, date, CASE WHEN count(x) {ROLL(60)} >= 36 THEN avg(x) {ROLL(60)} END AS m FROM v), o AS (SELECT symbol, arg_max(m, date) AS m FROM a GROUP BY symbol) SELECT symbol, round(1e6 * coalesce(m, (SELECT median(m) FROM o)), 6) AS amihud FROM o")
def amihud(spark, d):
    return I.amihud(bars(spark, d)).select("symbol", R(F.col("amihud") * 1e6, 6).alias("amihud"))


LR = f"lr AS (SELECT *, ln(close / lag(close) {WIN}) AS lr FROM bars)"


@query("realised_measures", f"WITH {BARS_SQL}, {LR}, b AS (SELECT *, abs(lr) * abs(lag(lr) {WIN}) AS b, pow(lr, 4) AS q FROM lr) SELECT symbol, date, round({MIN('stddev_samp', 'lr', 20)}, 6) AS rv, round({MIN('sum', 'q', 20)}, 6) AS rq, round({MIN('sum', 'b', 20)}, 6) AS bpv FROM b")
def realised_measures(spark, d):
    return rounded(I.realised(bars(spark, d)), "rv", "rq", "bpv")


@query("jump_days", f"WITH {BARS_SQL}, r AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM bars), c AS (SELECT symbol, quantile_cont(abs(ret), 0.95) AS cut FROM r GROUP BY symbol) SELECT symbol, count(*) FILTER (abs(ret) > cut) AS n_jumps, round(max(cut), 6) AS cut FROM r JOIN c USING (symbol) GROUP BY symbol")
def jump_days(spark, d):
    r = bars(spark, d).select("symbol", "date", P.pct_change("close", I.W()).alias("ret"))
    return I.jumps(r).groupBy("symbol").agg(F.sum("jump").alias("n_jumps"), R(F.max("cut"), 6).alias("cut"))


@query("autocorrelation", f"WITH {BARS_SQL}, r AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM bars), l AS (SELECT *, lag(ret) {WIN} AS l FROM r) SELECT symbol, round(corr(ret, l), 6) AS rho FROM l GROUP BY symbol")
def autocorrelation(spark, d):
    return rounded(I.autocorrelation(bars(spark, d).select("symbol", "date", P.pct_change("close", I.W()).alias("ret"))), "rho")


MFI = f"t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), f AS (SELECT *, CASE WHEN tp > lag(tp) {WIN} THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < lag(tp) {WIN} THEN tp * volume ELSE 0 END AS dn FROM t), m AS (SELECT *, 100 - 100 / (1 + {MIN('sum', 'up', 14)} / nullif({MIN('sum', 'dn', 14)}, 0)) AS mfi FROM f), g AS (SELECT *, lag(mfi) {WIN} AS m1 FROM m)"


@query("mfi_positions", f"WITH {BARS_SQL}, {MFI}, p AS (SELECT *, CASE WHEN mfi < 80 AND m1 >= 80 THEN -1 WHEN mfi > 20 AND m1 <= 20 THEN 1 END AS pulse FROM g) SELECT symbol, date, coalesce(last_value(pulse IGNORE NULLS) {WIN}, 0)::INTEGER AS position FROM p")
def mfi_positions(spark, d):
    pre = I.mfi(bars(spark, d))
    up = P.crosses_over("mfi", "_low", I.W())
    rows = pre.withColumn("_low", F.lit(20.0)).withColumn("_high", F.lit(80.0))
    rows = rows.withColumn("_b", up).withColumn("_s", P.crosses_under("mfi", "_high", I.W()))
    return rows.select("symbol", "date", I.held(F.col("_b"), F.col("_s")).alias("position"))


STOCH = f"k AS (SELECT *, 100 * (close - {MIN('min', 'low', 14)}) / nullif({MIN('max', 'high', 14)} - {MIN('min', 'low', 14)}, 0) AS k FROM bars), d AS (SELECT *, {MIN('avg', 'k', 3)} AS d FROM k), e AS (SELECT symbol, date, round(k, 6) AS k, round(d, 6) AS d FROM d), c AS (SELECT *, k > d AND lag(k) {WIN} <= lag(d) {WIN} AS up, k < d AND lag(k) {WIN} >= lag(d) {WIN} AS down FROM e)"


@query("stochastic_crosses", f"WITH {BARS_SQL}, {STOCH} SELECT symbol, count(*) FILTER (up AND k < 20) AS buys, count(*) FILTER (down AND k > 80) AS sells FROM c GROUP BY symbol")
def stochastic_crosses(spark, d):
    rows = rounded(I.stochastic(bars(spark, d)), "stoch_k", "stoch_d")
    rows = rows.withColumn("up", P.crosses_over("stoch_k", "stoch_d", I.W())).withColumn("down", P.crosses_under("stoch_k", "stoch_d", I.W()))
    return rows.groupBy("symbol").agg(F.count(F.when(F.col("up") & (F.col("stoch_k") < 20), 1)).alias("buys"), F.count(F.when(F.col("down") & (F.col("stoch_k") > 80), 1)).alias("sells"))


@query("obv_divergence", f"WITH {BARS_SQL}, {OBV}, x AS (SELECT *, {MIN('max', 'close', 20, 1)} AS ch, {MIN('min', 'close', 20, 1)} AS cl, {MIN('max', 'obv', 20, 1)} AS oh, {MIN('min', 'obv', 20, 1)} AS ol FROM obv) SELECT symbol, count(*) FILTER (close < cl AND obv >= ol) AS buys, count(*) FILTER (close > ch AND obv <= oh) AS sells FROM x GROUP BY symbol")
def obv_divergence(spark, d):
    rows = I.breakouts(I.obv(bars(spark, d)), 20)
    buy = (F.col("close") < F.col("close_lo_prev")) & (F.col("obv") >= F.col("obv_lo_prev"))
    sell = (F.col("close") > F.col("close_hi_prev")) & (F.col("obv") <= F.col("obv_hi_prev"))
    return rows.groupBy("symbol").agg(F.count(F.when(buy, 1)).alias("buys"), F.count(F.when(sell, 1)).alias("sells"))


@query("atr_breakouts", f"WITH {BARS_SQL}, {TR}, a AS (SELECT *, {MIN('avg', 'tr', 14)} AS atr, {MIN('max', 'high', 20, 1)} AS hi, {MIN('min', 'low', 20, 1)} AS lo FROM tr), b AS (SELECT *, lag(atr) {WIN} AS a1 FROM a) SELECT symbol, count(*) FILTER (close > hi + 0.5 * a1) AS buys, count(*) FILTER (close < lo - 0.5 * a1) AS sells FROM b GROUP BY symbol")
def atr_breakouts(spark, d):
    rows = I.breakouts(I.atr(bars(spark, d)))
    a1 = F.lag("atr").over(I.W())
    rows = rows.withColumn("b", F.col("close") > F.col("hi_prev") + 0.5 * a1).withColumn("s", F.col("close") < F.col("lo_prev") - 0.5 * a1)
    return rows.groupBy("symbol").agg(F.count(F.when(F.col("b"), 1)).alias("buys"), F.count(F.when(F.col("s"), 1)).alias("sells"))


@query("ema_crosses", f"WITH {BARS_SQL}, {NUM}, f AS {EWM('r', 'close', '(2.0/13)')}, s AS {EWM('r', 'close', '(2.0/27)')}, j AS (SELECT f.symbol, f.date, f.v AS f, s.v AS s FROM f JOIN s USING (symbol, date)), c AS (SELECT *, lag(f) {WIN} AS f1, lag(s) {WIN} AS s1 FROM j) SELECT symbol, count(*) FILTER (f > s AND f1 <= s1) AS buys, count(*) FILTER (f < s AND f1 >= s1) AS sells FROM c WHERE abs(f - s) > 1e-6 GROUP BY symbol")
def ema_crosses(spark, d):
    rows = I.exponential(bars(spark, d))
    rows = rows.withColumn("b", P.crosses_over("ema_fast", "ema_slow", I.W())).withColumn("s", P.crosses_under("ema_fast", "ema_slow", I.W())).filter("abs(ema_fast - ema_slow) > 1e-6")
    return rows.groupBy("symbol").agg(F.count(F.when(F.col("b"), 1)).alias("buys"), F.count(F.when(F.col("s"), 1)).alias("sells"))

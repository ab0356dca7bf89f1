"""Queries that calibrate trading rules: over the full grids, and each rule over a coarse grid with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import calibration as K
from quantloom.operators import indicators as I
from quantloom.plans.technical import EWM, NUM, OBV, ROLL, STATS, TR, WIN, R, rounded
from quantloom.sources.tables import BARS_SQL, bars

Q: dict = {}
SQL: dict[str, str] = {}

RET = f"close / lag(close) {WIN} - 1"
BY = lambda *p: f"OVER (PARTITION BY symbol, {', '.join(p)} ORDER BY date)"
OVER = lambda x, y, w: f"({x} > {y} AND lag({x}) {w} <= lag({y}) {w})"
UNDER = lambda x, y, w: f"({x} < {y} AND lag({x}) {w} >= lag({y}) {w})"
LIST = lambda values: "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"
FULL = lambda agg, x, n, s=0: f"CASE WHEN count({x}) {ROLL(int(n), s)} >= {int(n)} THEN {agg}({x}) {ROLL(int(n), s)} END"


def each(name: str, grid: dict, steps: str, buy: str, sell: str, source: str) -> None:
    """A rule's best set per symbol over a grid. steps: CTEs up to ``source`` (symbol, date, ret, the grid's columns and more)."""
    params = [f'"{p}"' for p in grid]
    keys = f"symbol, {', '.join(params)}"
    SQL[name] = f"""WITH {BARS_SQL}, {steps}, pl AS (SELECT {keys}, date, ret, CASE WHEN {sell} THEN -1 WHEN {buy} THEN 1 END AS pulse FROM {source}),
p0 AS (SELECT *, coalesce(last_value(pulse IGNORE NULLS) {BY(*params)}, 0) AS position FROM pl), {STATS(keys)}, sh AS (SELECT *, CASE WHEN sd > 1e-9 THEN sqrt(252.0) * mean / sd END AS sharpe FROM st)
SELECT {keys}, n, round(sharpe, 6) AS sharpe FROM sh QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC NULLS LAST, {', '.join(params)}) = 1"""

    def run(spark, d):
        rule = name.removesuffix("_grid")
        rows = K.calibrate(bars(spark, d), {rule: grid}, (rule,)).withColumn("p", F.from_json("param_json", "map<string, double>"))
        return rows.select("symbol", *[F.element_at("p", p).alias(p) for p in grid], "n", R("sharpe", 6).alias("sharpe"))

    Q[name] = run


def grids(name: str, **more) -> dict:
    return {**{k: v for k, v in K.GRIDS[name].items() if k not in {**K.COARSE.get(name, {}), **more}}, **K.COARSE.get(name, {}), **more}


def ordered(name: str, **more) -> dict:
    g = grids(name, **more)
    return {k: g[k] for k in K.GRIDS[name]}


LEVELS = lambda value, g: f"lv AS (SELECT v.symbol, v.date, v.ret, v.{value} AS v, v.w AS \"window\", lo AS low, hi AS high FROM v, (SELECT unnest({LIST(g['low'])}) AS lo), (SELECT unnest({LIST(g['high'])}) AS hi)), lw AS (SELECT *, lag(v) {BY('\"window\"', 'low', 'high')} AS v1 FROM lv)"
rule = ordered("rsi", window=[14])
each("rsi_grid", rule, f"{NUM}, u AS {EWM('r', 'up', '(1.0/14)')}, z AS {EWM('r', 'dn', '(1.0/14)')}, v AS (SELECT u.symbol, u.date, {RET.replace('close', 'r.close').replace(WIN, 'OVER (PARTITION BY u.symbol ORDER BY u.date)')} AS ret, 14.0::DOUBLE AS w, CASE WHEN u.n < 14 THEN NULL WHEN z.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / z.v) END AS x FROM u JOIN z USING (symbol, date) JOIN r ON r.symbol = u.symbol AND r.date = u.date), {LEVELS('x', rule)}", "v > low AND v1 <= low", "v < high AND v1 >= high", "lw")
rule = ordered("mfi", window=[10, 14])
FLOWS = f"t AS (SELECT *, {RET} AS ret, (high + low + close) / 3 AS tp FROM bars), f AS (SELECT *, CASE WHEN tp > lag(tp) {WIN} THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < lag(tp) {WIN} THEN tp * volume ELSE 0 END AS dn FROM t)"
each("mfi_grid", rule, f"{FLOWS}, v AS ({' UNION ALL '.join(f'SELECT symbol, date, ret, {n}.0::DOUBLE AS w, 100 - 100 / (1 + {FULL("sum", "up", n)} / nullif({FULL("sum", "dn", n)}, 0)) AS x FROM f' for n in rule['window'])}), {LEVELS('x', rule)}", "v > low AND v1 <= low", "v < high AND v1 >= high", "lw")
rule = ordered("bb", window=[10, 20, 30])
B_KEYS = BY('"window"', "width")
BANDS = " UNION ALL ".join(f'SELECT symbol, date, close, {RET} AS ret, {n}.0::DOUBLE AS "window", {FULL("avg", "close", n)} AS mid, {FULL("stddev_pop", "close", n)} AS sd FROM bars' for n in rule["window"])
each("bb_grid", rule, f"w AS ({BANDS}), x AS (SELECT w.*, width, mid - width * sd AS lo, mid + width * sd AS hi FROM w, (SELECT unnest({LIST(rule['width'])}) AS width)), y AS (SELECT *, {OVER('close', 'lo', B_KEYS)} AS b, {UNDER('close', 'hi', B_KEYS)} AS s FROM x)", "b", "s", "y")
rule = ordered("atr", window=[10, 14], **{"break": [20, 30]})
ENDS = f"SELECT symbol, date, close, ret, w AS \"window\", k AS \"break\", lag(atr) OVER (PARTITION BY symbol, w, k ORDER BY date) AS a, hi, lo FROM ({' UNION ALL '.join(f'SELECT symbol, date, close, ret, {n}.0::DOUBLE AS w, {k}.0::DOUBLE AS k, {FULL("avg", "tr", n)} AS atr, {FULL("max", "high", k, 1)} AS hi, {FULL("min", "low", k, 1)} AS lo FROM t' for n in rule['window'] for k in rule['break'])})"
each("atr_grid", rule, f"{TR}, t AS (SELECT *, {RET} AS ret FROM tr), e1 AS ({ENDS}), y AS (SELECT e1.*, mult FROM e1, (SELECT unnest({LIST(rule['mult'])}) AS mult))", "close > hi + mult * a", "close < lo - mult * a", "y")
rule = ordered("stoch")
each("stoch_grid", rule, f"k0 AS (SELECT *, {RET} AS ret, 100 * (close - {FULL('min', 'low', 14)}) / nullif({FULL('max', 'high', 14)} - {FULL('min', 'low', 14)}, 0) AS k FROM bars), k1 AS (SELECT *, {FULL('avg', 'k', 3)} AS d FROM k0), k2 AS (SELECT symbol, date, ret, k, {OVER('k', 'd', WIN)} AS u, {UNDER('k', 'd', WIN)} AS dn FROM k1), y AS (SELECT symbol, date, ret, k, u, dn, lo AS low, hi AS high FROM k2, (SELECT unnest({LIST(rule['low'])}) AS lo), (SELECT unnest({LIST(rule['high'])}) AS hi))", "u AND k < low", "dn AND k > high", "y")
SPANS = lambda *g: f"r AS (SELECT *, {RET} AS ret, row_number() {WIN} AS n FROM bars), e0 AS (SELECT b.symbol, b.date, b.ret, b.n, span, sum(c.close * CASE WHEN c.n = 1 THEN pow(1 - 2 / (span + 1), b.n - 1) ELSE 2 / (span + 1) * pow(1 - 2 / (span + 1), b.n - c.n) END) AS v FROM r b JOIN r c ON b.symbol = c.symbol AND c.n <= b.n, (SELECT unnest({LIST([x for y in g for x in y])}) AS span) GROUP BY ALL), m AS (SELECT f.symbol, f.date, f.ret, f.n, f.span AS fast, s.span AS slow, f.v AS f, s.v AS s, f.v - s.v AS m FROM e0 f JOIN e0 s USING (symbol, date) WHERE f.span IN ({', '.join(map(str, g[0]))}) AND s.span IN ({', '.join(map(str, g[1]))}))"
rule = ordered("ema")
E_KEYS = BY("fast", "slow")
each("ema_grid", rule, f"{SPANS(rule['fast'], rule['slow'])}, y AS (SELECT *, {OVER('f', 's', E_KEYS)} AS b, {UNDER('f', 's', E_KEYS)} AS x FROM m)", "b", "x", "y")
rule = {"fast": [8, 12], "slow": [20, 26], "signal": [6, 9]}
M_KEYS = BY("fast", "slow", "signal")
each("macd_grid", rule, f"{SPANS(rule['fast'], rule['slow'])}, g AS (SELECT b.symbol, b.date, b.ret, b.fast, b.slow, b.m, signal, sum(c.m * CASE WHEN c.n = 1 THEN pow(1 - 2 / (signal + 1), b.n - 1) ELSE 2 / (signal + 1) * pow(1 - 2 / (signal + 1), b.n - c.n) END) AS v FROM m b JOIN m c ON b.symbol = c.symbol AND b.fast = c.fast AND b.slow = c.slow AND c.n <= b.n, (SELECT unnest({LIST(rule['signal'])}) AS signal) GROUP BY ALL), y AS (SELECT *, {OVER('m', 'v', M_KEYS)} AS b, {UNDER('m', 'v', M_KEYS)} AS x FROM g)", "b", "x", "y")
rule = dict(K.GRIDS["vwap"])
V_KEYS = BY('"window"')
PRICES = " UNION ALL ".join(f'SELECT symbol, date, close, ret, {n}.0::DOUBLE AS "window", {FULL("sum", "pv", n)} / nullif({FULL("sum", "volume", n)}, 0) AS v FROM t' for n in rule["window"])
each("vwap_grid", rule, f"t AS (SELECT *, {RET} AS ret, (high + low + close) / 3 * volume AS pv FROM bars), v AS ({PRICES}), y AS (SELECT *, {OVER('close', 'v', V_KEYS)} AS b, {UNDER('close', 'v', V_KEYS)} AS x FROM v)", "b", "x", "y")
rule = dict(K.GRIDS["obv"])
TURNS = " UNION ALL ".join(f"SELECT symbol, date, ret, close, obv, {n}.0::DOUBLE AS lookback, {FULL('min', 'close', n, 1)} AS cl, {FULL('max', 'close', n, 1)} AS ch, {FULL('min', 'obv', n, 1)} AS ol, {FULL('max', 'obv', n, 1)} AS oh FROM t" for n in rule["lookback"])
each("obv_grid", rule, f"{OBV}, t AS (SELECT *, {RET} AS ret FROM obv), y AS ({TURNS})", "close < cl AND obv >= ol", "close > ch AND obv <= oh", "y")


def calibration(spark, d):
    rows = K.calibrate(bars(spark, d))
    return rounded(rows.select("symbol", "indicator", "param_json", "weight", "sharpe", "sharpe_bh", "t_stat", "p_value", "n"), "sharpe", "sharpe_bh", "t_stat", "p_value")


def calibration_screened(spark, d):
    rows = K.calibrate(bars(spark, d), screen=K.COARSE)
    return rounded(rows.select("symbol", "indicator", "param_json", "weight", "sharpe", "sharpe_bh", "t_stat", "p_value", "n"), "sharpe", "sharpe_bh", "t_stat", "p_value")


def calibrated_scores(spark, d):
    """Today's score of each symbol with the weights of its own calibration (windows and oscillators of the coarse grids)."""
    few = {n: {p: list(v)[:: max(1, len(v) // 3)] for p, v in {**g, **K.COARSE.get(n, {})}.items()} for n, g in K.GRIDS.items()}
    rows = I.calibrated_score(I.positions(I.precompute(bars(spark, d))), K.calibrate(bars(spark, d), few))
    return rows.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("score", "date").alias("score"))


Q |= {"calibration": calibration, "calibration_screened": calibration_screened, "calibrated_scores": calibrated_scores}

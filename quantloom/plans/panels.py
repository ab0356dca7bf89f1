"""Queries over joins, resampling, alignment, grouping and set primitives, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.functions import special as S
from quantloom.operators import align as A
from quantloom.operators import joins as J
from quantloom.plans.technical import R, BARS_SQL, WIN, rounded
from quantloom.sources import tables as T
from quantloom.sources.tables import UNIVERSE_SQL, bars, parquet, universe

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _resample(name, rule, label):
    @query(name, f"WITH {BARS_SQL} SELECT symbol, {label} AS date, round(arg_max(close, date), 6) AS close, round(arg_min(open, date), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, sum(volume) AS volume FROM bars GROUP BY ALL")
    def run(spark, d):
        return rounded(P.resample(bars(spark, d), rule, {"close": "last", "open": "first", "high": "max", "low": "min", "volume": "sum"}), "open", "high", "low", "close")


_resample("weekly_bars_sun", "W-SUN", "CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE)")
_resample("weekly_bars_fri", "W-FRI", "CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE)")
_resample("monthly_bars", "ME", "last_day(date)")
_resample("quarterly_bars", "QE", "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))")
_resample("yearly_bars", "YE", "make_date(year(date)::BIGINT, 12, 31)")


WEEKLY = f"""{BARS_SQL}, wk AS (SELECT symbol, CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL)"""


@query("weekly_spine_ffill", f"WITH {WEEKLY}, sp AS (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM wk GROUP BY symbol) SELECT symbol, date, round(last_value(close IGNORE NULLS) {WIN}, 6) AS close, close IS NULL AS filled FROM sp LEFT JOIN wk USING (symbol, date)")
def weekly_spine_ffill(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"})
    rows = P.spine(wk, "W-SUN").join(wk, ["symbol", "date"], "left")
    return rows.select("symbol", "date", R(P.ffill("close", P.over("symbol")), 6).alias("close"), F.col("close").isNull().alias("filled"))


@query("weekly_interpolated", f"WITH {WEEKLY}, sp AS (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM wk GROUP BY symbol), n AS (SELECT symbol, date, close, row_number() {WIN} AS i FROM sp LEFT JOIN wk USING (symbol, date)), g AS (SELECT *, last_value(close IGNORE NULLS) {WIN} AS a, last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) {WIN} AS ai, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi FROM n) SELECT symbol, date, round(coalesce(close, a + (b - a) * (i - ai) / (bi - ai)), 6) AS close FROM g")
def weekly_interpolated(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"})
    return rounded(P.interpolate(P.spine(wk, "W-SUN").join(wk, ["symbol", "date"], "left"), "close"), "close")


@query("business_spine", f"WITH {BARS_SQL}, sp AS (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars GROUP BY symbol) SELECT symbol, count(*) FILTER (isodow(date) < 6) AS n_days FROM sp GROUP BY symbol")
def business_spine(spark, d):
    return P.spine(bars(spark, d), "B").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"))


QUARTERS = """qs AS (SELECT c_nationkey AS country, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS date, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS sales, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def quarters(spark, d):
    o, c = parquet(spark, d, "orders"), parquet(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.groupBy(F.col("c_nationkey").alias("country"), P.quarter_end(F.to_date("o_orderdate")).alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("sales"), F.count(F.lit(1)).alias("n"))


@query("asof_statements", f"WITH {WEEKLY}, {UNIVERSE_SQL}, {QUARTERS}, l AS (SELECT s.s_nationkey AS country, symbol, date, close FROM wk JOIN supplier s ON s.s_suppkey = symbol), r AS (SELECT country, CAST(date + INTERVAL 90 DAY AS DATE) AS date, sales FROM qs) SELECT l.symbol, l.date, round(l.close, 6) AS close, round(r.sales, 2) AS sales FROM l ASOF LEFT JOIN r ON l.country = r.country AND l.date >= r.date")
def asof_statements(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"})
    sup = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("country"))
    out = J.asof_lagged(wk.join(sup, "symbol"), quarters(spark, d).select("country", "date", "sales"), 90, "country")
    return out.select("symbol", "date", R("close", 6).alias("close"), R("sales", 2).alias("sales"))


@query("asof_events", "WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT user_id, ts, value FROM events WHERE event_type <> (SELECT min(event_type) FROM events)) SELECT a.event_id, round(b.value, 4) AS value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_events(spark, d):
    e = parquet(spark, d, "events")
    first = e.agg(F.min("event_type").alias("t"))  # one row
    kinds = e.join(F.broadcast(first), e.event_type == first.t, "left")
    left = kinds.filter("t IS NOT NULL").select("event_id", "user_id", "ts")
    right = kinds.filter("t IS NULL").select("user_id", "ts", "value")
    return J.asof(left, right, "user_id", "ts", "ts", ["value"]).select("event_id", R("value", 4).alias("value"))


@query("range_mean_price", f"WITH {BARS_SQL}, q AS (SELECT DISTINCT symbol, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS date FROM bars) SELECT q.symbol, q.date, round(avg(b.close), 6) AS mean, count(b.close) AS n FROM q LEFT JOIN bars b ON b.symbol = q.symbol AND b.date BETWEEN q.date - 30 AND q.date + 30 GROUP BY ALL")
def range_mean_price(spark, d):
    b = bars(spark, d)
    q = b.select("symbol", P.quarter_end("date").alias("date")).distinct()
    return J.range_mean(q, b, "close", 30).select("symbol", "date", R("mean", 6).alias("mean"), F.coalesce("n_mean", F.lit(0)).alias("n"))


@query("size_buckets", f"WITH {UNIVERSE_SQL} SELECT symbol, CASE WHEN mcap < 2000 THEN 'Small' WHEN mcap >= 2000 AND mcap < 6000 THEN 'Mid' WHEN mcap >= 6000 THEN 'Large' ELSE 'Mid-Cap' END AS bucket FROM universe")
def size_buckets(spark, d):
    bounds = spark.createDataFrame([("Small", None, 2000.0), ("Mid", 2000.0, 6000.0), ("Large", 6000.0, None)], "bucket string, lo double, hi double")
    return J.bucket(universe(spark, d), "mcap", bounds, "bucket", "Mid-Cap").select("symbol", "bucket")


PEER = "p AS (SELECT p_partkey, p_brand, p_type, p_retailprice AS v FROM part)"


@query("hierarchical_fallback", f"WITH {PEER}, a AS (SELECT p_brand, p_type, avg(v) AS v FROM p GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT p_type, avg(v) AS v FROM p GROUP BY ALL HAVING count(*) >= 20), c AS (SELECT p_brand, avg(v) AS v FROM p GROUP BY ALL) SELECT p.p_partkey, round(coalesce(a.v, b.v, c.v), 4) AS peer FROM p LEFT JOIN a ON p.p_brand = a.p_brand AND p.p_type = a.p_type LEFT JOIN b ON p.p_type = b.p_type LEFT JOIN c ON p.p_brand = c.p_brand")
def hierarchical_fallback(spark, d):
    p = parquet(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").alias("v"))
    level = lambda keys, n: p.groupBy(*keys).agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n)
    out = J.fallback(p, [(level(["p_brand", "p_type"], 5), ["p_brand", "p_type"]), (level(["p_type"], 20), ["p_type"]), (level(["p_brand"], 1), ["p_brand"])], "m", "peer")
    return out.select("p_partkey", R("peer", 4).alias("peer"))


@query("leave_one_out", f"WITH {WEEKLY}, {UNIVERSE_SQL}, r AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM wk), j AS (SELECT r.*, region FROM r JOIN universe USING (symbol)), s AS (SELECT *, sum(ret) OVER (PARTITION BY region, date) AS t, count(ret) OVER (PARTITION BY region, date) AS n FROM j) SELECT symbol, date, round(CASE WHEN n - (ret IS NOT NULL)::INT > 0 THEN (t - coalesce(ret, 0)) / (n - (ret IS NOT NULL)::INT) END, 6) AS peers FROM s")
def leave_one_out(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"}).withColumn("ret", P.pct_change("close", P.over("symbol")))
    rows = J.leave_one_out(wk.join(universe(spark, d).select("symbol", "region"), "symbol"), "ret", ["region", "date"], "peers")
    return rows.select("symbol", "date", R("peers", 6).alias("peers"))


@query("clip_outliers_iqr", "WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part GROUP BY ALL) SELECT p_partkey, round(least(greatest(p_retailprice, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 4) AS price FROM part JOIN q USING (p_brand)")
def clip_outliers_iqr(spark, d):
    p = A.clip_outliers(parquet(spark, d, "part"), ["p_retailprice"], ["p_brand"], 0.5)
    return p.select("p_partkey", R("p_retailprice", 4).alias("price"))


@query("winsorize_mad", "WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.05) AS a, quantile_cont(p_retailprice, 0.95) AS b, median(p_retailprice) AS m FROM part GROUP BY ALL), k AS (SELECT p_brand, 1.4826 * median(abs(p_retailprice - m)) AS s FROM part JOIN q USING (p_brand) GROUP BY ALL) SELECT p_partkey, round(least(greatest(p_retailprice, a), b), 4) AS winsor, round(least(greatest(p_retailprice, m - 1.0 * s), m + 1.0 * s), 4) AS mad FROM part JOIN q USING (p_brand) JOIN k USING (p_brand)")
def winsorize_mad(spark, d):
    p = parquet(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("winsor"), F.col("p_retailprice").alias("mad"))
    p = A.mad_clip(A.winsorize(p, "winsor", 0.05, ["p_brand"]), "mad", ["p_brand"], 1.0)
    return rounded(p.select("p_partkey", "winsor", "mad"), "winsor", "mad", n=4)


@query("robust_scale", "WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.05) AS a, quantile_cont(p_retailprice, 0.95) AS b FROM part GROUP BY ALL), w AS (SELECT p_partkey, p_brand, least(greatest(p_retailprice, a), b) AS v FROM part JOIN q USING (p_brand)), m AS (SELECT p_brand, median(v) AS m FROM w GROUP BY ALL), s AS (SELECT p_brand, 1.4826 * median(abs(v - m)) AS s FROM w JOIN m USING (p_brand) GROUP BY ALL) SELECT p_partkey, round((v - m) / s, 6) AS z FROM w JOIN m USING (p_brand) JOIN s USING (p_brand)")
def robust_scale(spark, d):
    return rounded(A.robust_scale(parquet(spark, d, "part"), "p_retailprice", ["p_brand"], "z").select("p_partkey", "z"), "z")


@query("peer_granularities", "WITH g AS (SELECT p_brand, p_type, p_size, avg(p_retailprice) AS v, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_brand, p_size), ())) SELECT p_brand, p_type, p_size, round(v, 4) AS v, n FROM g")
def peer_granularities(spark, d):
    parquet(spark, d, "part").createOrReplaceTempView("quantloom_part")
    return rounded(spark.sql("SELECT p_brand, p_type, p_size, avg(p_retailprice) AS v, count(*) AS n FROM quantloom_part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_brand, p_size), ())"), "v", n=4)


@query("cube_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, 'cube' AS kind FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, sum(l_quantity), count(*), 'rollup' FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def cube_rollup(spark, d):
    li = parquet(spark, d, "lineitem")
    agg = lambda g, kind: g.agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return agg(li.cube("l_returnflag", "l_linestatus"), "cube").unionByName(agg(li.rollup("l_returnflag", "l_linestatus"), "rollup"))


@query("ranks", "SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(10) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS decile, round(percent_rank() OVER w, 6) AS pr FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)")
def ranks(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice")
    return parquet(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(10).over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")).cast("long").alias("decile"), R(F.percent_rank().over(w), 6).alias("pr"))


@query("top_orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_orders(spark, d):
    return P.top_k(parquet(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("keep_last", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark, d):
    return P.keep_last(parquet(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("set_operations", "WITH a AS (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT 'intersect' AS op, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'union', k FROM (SELECT k FROM a UNION SELECT k FROM b)")
def set_operations(spark, d):
    a = parquet(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    b = parquet(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"))
    name = lambda x, op: x.select(F.lit(op).alias("op"), "k")
    return name(a.intersect(b), "intersect").unionByName(name(b.subtract(a), "except")).unionByName(name(a.union(b).distinct(), "union"))


@query("semi_anti", "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS active, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS idle FROM customer GROUP BY 1")
def semi_anti(spark, d):
    c, o = parquet(spark, d, "customer"), parquet(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    rows = c.join(o.withColumn("a", F.lit(1)), "c_custkey", "left")
    return rows.groupBy("c_mktsegment").agg(F.count("a").alias("active"), (F.count(F.lit(1)) - F.count("a")).alias("idle"))


@query("pivot_unpivot", "WITH p AS (SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS o, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS f FROM lineitem GROUP BY 1) SELECT l_returnflag, 'O' AS status, o AS qty FROM p UNION ALL SELECT l_returnflag, 'F', f FROM p")
def pivot_unpivot(spark, d):
    p = parquet(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return p.unpivot("l_returnflag", ["O", "F"], "status", "qty")


@query("runs", f"WITH {WEEKLY}, r AS (SELECT symbol, date, sign(close - lag(close) {WIN}) AS s FROM wk), g AS (SELECT *, row_number() {WIN} - row_number() OVER (PARTITION BY symbol, s ORDER BY date) AS g FROM r WHERE s IS NOT NULL), l AS (SELECT symbol, s, g, count(*) AS n FROM g GROUP BY ALL) SELECT symbol, coalesce(max(n) FILTER (s > 0), 0) AS up, coalesce(max(n) FILTER (s < 0), 0) AS down FROM l GROUP BY symbol")
def runs(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"}).withColumn("s", F.signum(P.diff("close", P.over("symbol")))).filter("s IS NOT NULL")
    r = P.runs(wk, F.col("s"))
    best = lambda cond: F.coalesce(F.max(F.when(cond, F.col("length"))), F.lit(0))
    return r.groupBy("symbol").agg(best(F.col("state") > 0).alias("up"), best(F.col("state") < 0).alias("down"))


@query("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, d):
    e = parquet(spark, d, "events").withColumn("p", F.from_json("props", "map<string,bigint>"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("p", "k")).alias("k"))


@query("parse_text_numbers", "SELECT o_orderkey, round(o_totalprice / 1000, 1) * 1000 AS abbreviated, round(o_totalprice % 100 / 100, 4) AS growth FROM orders")
def parse_text_numbers(spark, d):
    o = parquet(spark, d, "orders")
    text = F.concat(R(F.col("o_totalprice") / 1000, 1).cast("string"), F.lit("K"))
    pct = F.concat((F.col("o_totalprice") % 100).cast("decimal(20,6)").cast("string"), F.lit("%"))
    return o.select("o_orderkey", T.abbreviated(text).alias("abbreviated"), R(T.growth(pct), 4).alias("growth"))


@query("quarter_labels", "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS label, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS date FROM orders")
def quarter_labels(spark, d):
    o = parquet(spark, d, "orders").select(F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("label")).distinct()
    return o.select("label", T.quarter_label(F.col("label")).alias("date"))


@query("macro_midas", f"WITH {QUARTERS} SELECT country, date, round(" + " + ".join(f"{w!r} * coalesce(lag(sales, {j}) OVER (PARTITION BY country ORDER BY date), 0)" for j, w in enumerate(A.exponential_midas(8, 0.3))) + ", 2) AS sales_midas FROM qs")
def macro_midas(spark, d):
    return rounded(A.midas(quarters(spark, d), "sales").select("country", "date", "sales_midas"), "sales_midas", n=2)


@query("growth_features", f"WITH {QUARTERS} SELECT country, date, round(sales / lag(sales) OVER w - 1, 6) AS sales_qoq, round(sales / lag(sales, 4) OVER w - 1, 6) AS sales_yoy FROM qs WINDOW w AS (PARTITION BY country ORDER BY date)")
def growth_features(spark, d):
    return rounded(A.growth_features(quarters(spark, d), ["sales"], "country").select("country", "date", "sales_qoq", "sales_yoy"), "sales_qoq", "sales_yoy")


@query("forward_sum", f"WITH {WEEKLY}, r AS (SELECT symbol, date, ln(close / lag(close) {WIN}) AS lr FROM wk) SELECT symbol, date, round(CASE WHEN count(lr) OVER f = 4 THEN sum(lr) OVER f END, 6) AS target FROM r WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)")
def forward_sum(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"}).withColumn("lr", P.log_return("close", P.over("symbol")))
    return wk.select("symbol", "date", R(A.forward_sum("lr", 4), 6).alias("target"))


@query("analyst_targets", "WITH t AS (SELECT l_suppkey AS symbol, min(l_extendedprice) AS lo, median(l_extendedprice) AS med, avg(l_extendedprice) AS av, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT *, (av - med) / med AS skew FROM t) SELECT symbol, round(CASE WHEN abs(skew) > 0.1 THEN (lo + 2 * med + hi) / 4 ELSE av END, 4) AS target, round(CASE WHEN abs(skew) > 0.1 THEN sqrt((pow(med - lo, 2) + pow(hi - med, 2)) / 12) END, 4) AS sigma_skewed FROM s")
def analyst_targets(spark, d):
    t = parquet(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.min("l_extendedprice").alias("lo"), F.percentile("l_extendedprice", F.lit(0.5)).alias("med"), F.avg("l_extendedprice").alias("av"), F.max("l_extendedprice").alias("hi"))
    skewed = F.abs((F.col("av") - F.col("med")) / F.col("med")) > 0.1
    return t.select("symbol", R(F.when(skewed, (F.col("lo") + 2 * F.col("med") + F.col("hi")) / 4).otherwise(F.col("av")), 4).alias("target"), R(F.when(skewed, F.sqrt((F.pow(F.col("med") - F.col("lo"), 2) + F.pow(F.col("hi") - F.col("med"), 2)) / 12)), 4).alias("sigma_skewed"))


@query("target_dispersion")
def target_dispersion(spark, d):
    """(max - min) / (2 z price), z the normal quantile of 1 - 1/n."""
    t = parquet(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.min("l_extendedprice").alias("lo"), F.avg("l_extendedprice").alias("p"), F.max("l_extendedprice").alias("hi"), F.count(F.lit(1)).alias("n"))
    z = F.when(F.col("n") < 2, 2.0).when(F.col("n") == 2, 3.0).otherwise(S.ppf(1 - 1 / F.col("n")))
    return t.select("symbol", R((F.col("hi") - F.col("lo")) / (2 * z * F.col("p")), 6).alias("sigma"))


@query("synthetic_forecast", f"""WITH {QUARTERS}, g AS (SELECT country AS symbol, sales / lag(sales) OVER (PARTITION BY country ORDER BY date) - 1 AS g FROM qs), q AS (SELECT symbol, quantile_cont(g, 0.25) AS a, quantile_cont(g, 0.75) AS b FROM g GROUP BY 1), k AS (SELECT symbol, min(g) AS lo, avg(g) AS av, max(g) AS hi FROM g JOIN q USING (symbol) WHERE g BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY 1), l AS (SELECT country AS symbol, arg_max(sales, date) AS base FROM qs GROUP BY 1), s AS (SELECT *, unnest(range(1, 7)) AS step FROM l JOIN k USING (symbol)), f AS (SELECT *, base * pow(1 + av, greatest(step - 2, 0)) AS before FROM s)
SELECT symbol, step::INTEGER AS step, round(CASE WHEN step = 1 THEN base ELSE before * (1 + lo) END, 2) AS low, round(CASE WHEN step = 1 THEN base ELSE before * (1 + av) END, 2) AS avg, round(CASE WHEN step = 1 THEN base ELSE before * (1 + hi) END, 2) AS high FROM f""")
def synthetic_forecast(spark, d):
    h = quarters(spark, d).select(F.col("country").alias("symbol"), "date", F.col("sales").alias("value"))
    return rounded(A.synthetic_forecast(h), "low", "avg", "high", n=2)


@query("unit_flip_repair")
def unit_flip_repair(spark, d):
    b = bars(spark, d).select("symbol", "date", F.when(F.dayofmonth("date") % 5 == 0, F.col("close") * 100).otherwise(F.col("close")).alias("close"))
    return rounded(A.repair_unit_flips(b), "close")


@query("fx_conversion", f"""WITH {BARS_SQL}, c AS (SELECT symbol, date, close, CASE symbol % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'JPY' END AS ccy FROM bars), w AS (SELECT DISTINCT date FROM bars WHERE isodow(date) < 6), g AS (SELECT (SELECT min(date) FROM bars) AS lo)
SELECT symbol, c.date, ccy, round(close * CASE ccy WHEN 'GBP' THEN 1 WHEN 'USD' THEN 1 / (1.3 + dayofyear(w.date) / 1000) ELSE 1 / (110 + dayofyear(w.date) / 10) / (1.3 + dayofyear(w.date) / 1000) END, 6) AS close FROM c ASOF LEFT JOIN w ON c.date >= w.date""")
def fx_conversion(spark, d):
    b = bars(spark, d).select("symbol", "date", "close", F.when(F.col("symbol") % 3 == 0, "GBP").when(F.col("symbol") % 3 == 1, "USD").otherwise("JPY").alias("ccy"))
    days = b.select("date").distinct()
    quotes = days.select(F.lit("GBPUSD").alias("pair"), "date", (1.3 + F.dayofyear("date") / 1000).alias("rate")).unionByName(days.select(F.lit("USDJPY"), "date", (110 + F.dayofyear("date") / 10).alias("rate")).toDF("pair", "date", "rate"))
    return rounded(A.to_base(b, A.usd_per_ccy(quotes), "GBP").select("symbol", "date", "ccy", "close"), "close")


@query("outer_panel", f"WITH {BARS_SQL}, a AS (SELECT date, avg(close) AS v FROM bars WHERE symbol % 2 = 0 GROUP BY 1), b AS (SELECT date, max(high) AS v FROM bars WHERE symbol % 7 = 0 GROUP BY 1) SELECT coalesce(a.date, b.date) AS date, round(a.v, 6) AS even, round(b.v, 6) AS seventh FROM a FULL JOIN b ON a.date = b.date")
def outer_panel(spark, d):
    b = bars(spark, d)
    one = lambda cond, agg: b.filter(cond).groupBy("date").agg(agg.alias("v"))
    return rounded(J.outer_panel({"even": (one("symbol % 2 = 0", F.avg("close")), "v"), "seventh": (one("symbol % 7 = 0", F.max("high")), "v")}), "even", "seventh")


@query("lag_windows", f"WITH {WEEKLY}, r AS (SELECT symbol, date, close / lag(close) {WIN} - 1 AS ret FROM wk), f AS (SELECT symbol, date, ret, lag(ret) {WIN} AS l1, lag(ret, 2) {WIN} AS l2, lag(ret, 3) {WIN} AS l3 FROM r) SELECT symbol, date, round(l1, 6) AS ret_l1, round(l2, 6) AS ret_l2, round(l3, 6) AS ret_l3 FROM f")
def lag_windows(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"}).withColumn("ret", P.pct_change("close", P.over("symbol")))
    return rounded(A.lag_features(wk, ["ret"], [1, 2, 3]).select("symbol", "date", "ret_l1", "ret_l2", "ret_l3"), "ret_l1", "ret_l2", "ret_l3")


@query("momentum_z", f"WITH {WEEKLY}, {UNIVERSE_SQL}, m AS (SELECT symbol, date, close / lag(close, 26) {WIN} - 1 AS m FROM wk), l AS (SELECT symbol, arg_max(m, date) AS m FROM m WHERE m IS NOT NULL GROUP BY symbol), r AS (SELECT region, avg(m) AS m FROM l JOIN universe USING (symbol) GROUP BY region) SELECT region, round((m - avg(m) OVER ()) / stddev_samp(m) OVER (), 6) AS z FROM r")
def momentum_z(spark, d):
    wk = P.resample(bars(spark, d), "W-SUN", {"close": "last"}).withColumn("m", P.pct_change("close", P.over("symbol"), 26)).filter("m IS NOT NULL")
    last = wk.groupBy("symbol").agg(F.max_by("m", "date").alias("m")).join(universe(spark, d).select("symbol", "region"), "symbol")
    r = last.groupBy("region").agg(F.avg("m").alias("m"))
    all_ = r.agg(F.avg("m").alias("a"), F.stddev_samp("m").alias("s"))  # one row
    return r.crossJoin(F.broadcast(all_)).select("region", R((F.col("m") - F.col("a")) / F.col("s"), 6).alias("z"))

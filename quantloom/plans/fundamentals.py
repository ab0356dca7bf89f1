"""Queries over fundamentals: scores, blending, valuation and text, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import scores as S
from quantloom.operators import text as X
from quantloom.operators import valuation as V
from quantloom.plans.performance import BENCH, RETS, benchmark, weekly_returns
from quantloom.plans.technical import R, rounded
from quantloom.sources.tables import parquet

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


#: Stand-ins for analyst data: each field is (multiplier, modulus, scale, offset) of the symbol; every 13th value is NULL.
FIELDS = {
    "shares_short": (37, 101, 1.0, 5.0), "shares_out": (53, 997, 1.0, -50.0), "shares_short_prior": (41, 103, 1.0, 5.0), "sentiment": (29, 100, 100.0, 0.5), "mentions": (17, 20, 1.0, 0.0),
    "earnings_growth": (31, 90, 100.0, 0.4), "ind_earnings_growth": (7, 50, 100.0, 0.2), "trailing_eps": (43, 110, 10.0, 2.0), "eps_pred": (47, 107, 10.0, 2.0), "forward_eps": (59, 113, 10.0, 2.0),
    "ocf": (61, 211, 1.0, 50.0), "net_income": (67, 223, 1.0, 60.0), "revenue_growth": (71, 60, 100.0, 0.2), "ind_revenue_growth": (73, 40, 100.0, 0.1), "revenue": (79, 907, 1.0, -100.0), "revenue_pred": (83, 911, 1.0, -100.0),
    "roe": (89, 70, 100.0, 0.3), "ind_roe": (97, 40, 100.0, 0.1), "roa": (101, 50, 100.0, 0.2), "prev_roa": (103, 50, 100.0, 0.2), "ind_roa": (107, 30, 100.0, 0.1), "asset_growth": (109, 60, 100.0, 0.2), "asset_growth_vol": (113, 30, 100.0, 0.0),
    "pb": (127, 60, 10.0, 1.0), "ind_pb": (131, 40, 10.0, 0.0), "price": (137, 401, 1.0, -10.0), "ind_pe": (139, 30, 1.0, -5.0), "up_slope": (149, 25, 10.0, 0.0), "down_slope": (151, 25, 10.0, 0.5), "up_ratio": (157, 25, 10.0, 0.0), "down_ratio": (163, 25, 10.0, 0.5),
    "low_target": (167, 401, 1.0, -10.0), "insider_purchases": (173, 9, 1.0, 4.0), "prev_long_debt": (179, 503, 1.0, 0.0), "long_debt": (181, 503, 1.0, 0.0), "prev_current_ratio": (191, 40, 10.0, 0.0), "current_ratio": (193, 40, 10.0, 0.0),
    "beta": (197, 25, 10.0, 0.3), "vol_short": (199, 40, 100.0, 0.0), "vol_long": (211, 40, 100.0, -0.05), "shares_issued": (223, 9, 1.0, 4.0), "d_to_e": (227, 60, 10.0, 0.5), "gross_margin": (229, 90, 100.0, 0.0), "prev_gross_margin": (233, 90, 100.0, 0.0),
    "asset_turnover": (239, 20, 10.0, 0.0), "prev_asset_turnover": (241, 20, 10.0, 0.0), "div_yield": (251, 12, 100.0, 0.0), "net_issuance": (257, 101, 1.0, 50.0), "mcap": (263, 997, 1.0, -100.0), "skew": (269, 20, 10.0, 1.0), "kurt": (271, 130, 10.0, 0.0),
    "sharpe": (277, 30, 10.0, 1.0), "sortino": (281, 30, 10.0, 1.0), "signal_score": (283, 21, 1.0, 10.0), "alpha": (293, 21, 100.0, 0.1), "pred_alpha": (307, 21, 100.0, 0.1), "eps_rev_7": (311, 9, 1.0, 4.0), "eps_rev_30": (313, 9, 1.0, 4.0),
}
FIELD_SQL = [f"CASE WHEN ({m} + symbol) % 13 = 0 THEN NULL ELSE (({m} * symbol) % {mod}) / CAST({s} AS DOUBLE) - CAST({o} AS DOUBLE) END AS {n}" for n, (m, mod, s, o) in FIELDS.items()]
FIELD_SQL.append("CASE symbol % 5 WHEN 0 THEN 'STRONG_BUY' WHEN 1 THEN 'hold' WHEN 2 THEN 'sell' WHEN 3 THEN 'buy' END AS recommendation")
ANALYST = f"analyst AS (SELECT symbol, {', '.join(FIELD_SQL)} FROM (SELECT s_suppkey AS symbol FROM supplier))"
CUTS = f"cuts AS (SELECT quantile_cont(CASE WHEN {S.SHORT} <> 0 THEN {S.SHORT} END, 0.75) AS short_p75, coalesce(quantile_cont(CASE WHEN coalesce(earnings_growth, 0) <> 0 THEN earnings_growth END, 0.75), 1e300) AS growth_p75, CASE WHEN max(div_yield) > 5 THEN 100.0 ELSE 1.0 END AS yield_unit FROM analyst)"


def analyst(spark, d):
    return parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol")).selectExpr("symbol", *FIELD_SQL)


@query("fundamental_scores", f"WITH {ANALYST}, {CUTS}, s AS (SELECT symbol, {', '.join(f'CAST({e} AS INTEGER) AS s_{n}' for n, e in S.RULES.items())} FROM analyst, cuts) SELECT *, {' + '.join(f's_{n}' for n in S.RULES)} AS score FROM s")
def fundamental_scores(spark, d):
    return S.score(analyst(spark, d))


MODELS = "models AS (SELECT s_suppkey AS symbol, m AS model, CASE WHEN (s_suppkey * (m + 3)) % 11 = 0 THEN 0.0 ELSE ((s_suppkey * (m * 7 + 5)) % 83) / 100.0::DOUBLE - 0.3 END AS ret, ((s_suppkey * (m + 11)) % 37) / 100.0::DOUBLE + 0.01 AS se FROM supplier, (SELECT unnest(range(1, 13)) AS m))"


def models(spark, d):
    s = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("model"))
    ret = F.when((F.col("symbol") * (F.col("model") + 3)) % 11 == 0, 0.0).otherwise(((F.col("symbol") * (F.col("model") * 7 + 5)) % 83) / 100.0 - 0.3)
    return s.select("symbol", "model", ret.alias("ret"), (((F.col("symbol") * (F.col("model") + 11)) % 37) / 100.0 + 0.01).alias("se"))


BLEND = "v AS (SELECT symbol, model, least(greatest(ret, -0.8), 4) AS r, 1 / pow(least(greatest(se, 0.01), 2), 2) AS i FROM models WHERE ret NOT IN (-1, 0) AND se > 0.02)"


@query("forecast_blend", f"WITH {MODELS}, {BLEND}, m AS (SELECT symbol, count(*) AS n, sum(i) AS si, sum(i * r) / sum(i) AS mu, sum(i * r * r) / sum(i) AS m2 FROM v GROUP BY symbol) SELECT symbol, n, round(mu, 6) AS ret, round(sqrt(least(greatest(1 / si + m2 - mu * mu, 0.0001), 4)), 6) AS se FROM m")
def forecast_blend(spark, d):
    return rounded(S.blend(models(spark, d)), "ret", "se")


@query("forecast_weights", f"WITH {MODELS}, {BLEND} SELECT symbol, model, round(i / sum(i) OVER (PARTITION BY symbol), 6) AS weight FROM v")
def forecast_weights(spark, d):
    return rounded(S.forecast_weights(models(spark, d)), "weight")


@query("forecast_blend_capped")
def forecast_blend_capped(spark, d):
    groups = {"intrinsic": ([1, 2, 3, 4], 0.3), "history": ([5, 6], 0.1), "pair": ([1, 7], 0.12)}
    return rounded(S.bull_bear(S.capped_blend(models(spark, d), groups)), "ret", "se", "max_weight", "bear", "bull")


@query("clean_predictions", f"WITH {MODELS}, b AS (SELECT *, se <= 0.02 OR ret <= -0.8 AS bad FROM models) SELECT symbol, model, round(CASE WHEN bad THEN 0 ELSE least(ret, 4) END, 6) AS ret, round(CASE WHEN bad THEN 0 ELSE least(se, 2) END, 6) AS se FROM b")
def clean_predictions(spark, d):
    return rounded(S.clean_predictions(models(spark, d)), "ret", "se")


INPUT_SQL = """inputs AS (SELECT s_suppkey AS symbol, 20.0 + s_suppkey % 80 AS price, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey % 17) / 4.0 - 0.5 END AS eps_avg, (s_suppkey % 17) / 5.0 - 0.5 AS eps_low, (s_suppkey % 17) / 3.0 AS eps_high,
 (s_suppkey % 19) / 5.0 AS eps_low_y, (s_suppkey % 19) / 4.0 AS eps_avg_y, (s_suppkey % 19) / 3.0 AS eps_high_y, 100.0 + s_suppkey AS rev_low, 120.0 + s_suppkey AS rev_avg, 150.0 + s_suppkey AS rev_high, 110.0 + s_suppkey AS rev_low_y, 130.0 + s_suppkey AS rev_avg_y, 160.0 + s_suppkey AS rev_high_y,
 10.0 + s_suppkey % 30 AS shares, 0.5 + s_suppkey % 3 AS mc_ev, 5.0 + s_suppkey % 23 AS bvps, (s_suppkey % 4) / 2.0 AS dps, 8.0 + s_suppkey % 20 AS pe1, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 12.0 + s_suppkey % 10 END AS pe2, 1.0 + s_suppkey % 5 AS ps1, 2.0 + s_suppkey % 3 AS ps2, 1.0 + s_suppkey % 4 AS pb1, 2.0 + s_suppkey % 2 AS pb2,
 0.07 + (s_suppkey % 6) / 100.0 AS coe, (s_suppkey % 5) / 100.0 AS g, (s_suppkey % 10) / 10.0 AS payout FROM supplier)"""


def inputs(spark, d):
    k = F.col("s_suppkey")
    f = lambda x: x.cast("double")
    return parquet(spark, d, "supplier").select(
        k.alias("symbol"), f(20 + k % 80).alias("price"), F.when(k % 9 == 0, None).otherwise((k % 17) / 4 - 0.5).alias("eps_avg"), ((k % 17) / 5 - 0.5).alias("eps_low"), ((k % 17) / 3).alias("eps_high"),
        ((k % 19) / 5).alias("eps_low_y"), ((k % 19) / 4).alias("eps_avg_y"), ((k % 19) / 3).alias("eps_high_y"), *[f(n + k).alias(c) for n, c in ((100, "rev_low"), (120, "rev_avg"), (150, "rev_high"), (110, "rev_low_y"), (130, "rev_avg_y"), (160, "rev_high_y"))],
        f(10 + k % 30).alias("shares"), f(0.5 + k % 3).alias("mc_ev"), f(5 + k % 23).alias("bvps"), ((k % 4) / 2).alias("dps"), f(8 + k % 20).alias("pe1"), F.when(k % 7 == 0, None).otherwise(f(12 + k % 10)).alias("pe2"), f(1 + k % 5).alias("ps1"), f(2 + k % 3).alias("ps2"), f(1 + k % 4).alias("pb1"), f(2 + k % 2).alias("pb2"),
        (0.07 + (k % 6) / 100).alias("coe"), ((k % 5) / 100).alias("g"), ((k % 10) / 10).alias("payout"),
    )


def candidates(values, multiples, formula):
    arr = lambda cols: f"(SELECT symbol, unnest(list_filter([{', '.join(cols)}], lambda x: x IS NOT NULL)) AS {{}} FROM inputs)"
    return f"""WITH {INPUT_SQL}, e AS {arr(values).format('e')}, m AS {arr(multiples).format('m')},
c AS (SELECT symbol, price, least(greatest({formula}, 0.2 * price), 5 * price) AS p FROM inputs JOIN e USING (symbol) JOIN m USING (symbol))
SELECT symbol, round(min(p), 6) AS low, round(avg(p), 6) AS avg, round(max(p), 6) AS high, round(avg(p / price - 1), 6) AS ret, round(stddev_pop(p / price - 1), 6) AS se FROM c GROUP BY symbol"""


VALUES = ("low", "avg", "high", "ret", "se")


def valued(df):
    return rounded(df.select("symbol", *VALUES), *VALUES)


EPS0 = [f"CASE WHEN {c} IS NOT NULL THEN greatest({c}, 0) END" for c in V.EPS]


@query("price_earnings", candidates(EPS0, ["pe1", "pe2"], "e * m"))
def price_earnings(spark, d):
    return valued(V.price_earnings(inputs(spark, d), ("pe1", "pe2")))


@query("price_sales", candidates(V.REV, ["ps1", "ps2"], "e * m / shares"))
def price_sales(spark, d):
    return valued(V.price_sales(inputs(spark, d), ("ps1", "ps2")))


@query("ev_sales", candidates(V.REV, ["ps1", "ps2"], "e * m / shares * mc_ev"))
def ev_sales(spark, d):
    return valued(V.ev_sales(inputs(spark, d), ("ps1", "ps2")))


@query("price_book", candidates(V.EPS, ["pb1", "pb2"], "greatest(bvps + e - dps, 0) * m"))
def price_book(spark, d):
    return valued(V.price_book(inputs(spark, d), ("pb1", "pb2")))


@query("graham_number", candidates(V.EPS, ["pe1 * pb1", "pe1 * pb2", "pe2 * pb1", "pe2 * pb2"], "sqrt(m * greatest(e, 0) * greatest(bvps + e - dps, 0))"))
def graham_number(spark, d):
    return valued(V.graham(inputs(spark, d), ("pe1", "pe2"), ("pb1", "pb2")))


REL = lambda values, multiples, formula: f"SELECT symbol, price, least(greatest({formula}, 0.2 * price), 5 * price) AS p FROM inputs JOIN (SELECT symbol, unnest(list_filter([{', '.join(values)}], lambda x: x IS NOT NULL)) AS e FROM inputs) USING (symbol) JOIN (SELECT symbol, unnest(list_filter([{', '.join(multiples)}], lambda x: x IS NOT NULL)) AS m FROM inputs) USING (symbol)"


@query("relative_value", f"WITH {INPUT_SQL}, c AS ({REL(EPS0, ['pe1', 'pe2'], 'e * m')} UNION ALL {REL(V.REV, ['ps1', 'ps2'], 'e * m / shares')} UNION ALL {REL(V.EPS, ['pb1', 'pb2'], 'greatest(bvps + e - dps, 0) * m')}) SELECT symbol, round(min(p), 6) AS low, round(avg(p), 6) AS avg, round(max(p), 6) AS high, round(avg(p / price - 1), 6) AS ret, round(stddev_pop(p / price - 1) / sqrt(5), 6) AS se FROM c GROUP BY symbol")
def relative_value(spark, d):
    return valued(V.relative_value(inputs(spark, d), ("pe1", "pe2"), ("ps1", "ps2"), ("pb1", "pb2")))


@query("gordon_growth", f"WITH {INPUT_SQL} SELECT symbol, round(CASE WHEN dps / price >= 0.01 THEN least(greatest(dps * (1 + g) / greatest(coe - g, 0.01), 0.2 * price), 5 * price) END, 6) AS ggm FROM inputs")
def gordon_growth(spark, d):
    return rounded(V.gordon(inputs(spark, d)).select("symbol", "ggm"), "ggm")


TRIPLES = lambda p: f"[{', '.join(f'[{p}_low * {k}, {p}_avg_y * {k}, {p}_high_y * {k}]' for k in ('1.0', '1.1', '1.2'))}]"
DCF_SQL = f"""WITH {INPUT_SQL}, p AS (SELECT *, unnest(range(0, 27)) AS path FROM inputs), x AS (SELECT *, {TRIPLES('rev')} AS rev, {TRIPLES('eps')} AS eps, 1.0 + symbol % 5 AS b0 FROM p),
y AS (SELECT *, {' + '.join(f'(b0 + 0.1 * rev[{t + 1}][(path // {3**t}) % 3 + 1] + 2.0 * eps[{t + 1}][(path // {3**t}) % 3 + 1]) * pow(1 + coe, -{t + 1})' for t in range(3))} AS pv, greatest(eps[3][(path // 9) % 3 + 1], 0) * pow(1 + coe, -3) AS last FROM x),
z AS (SELECT symbol, price, least(greatest(pv / shares + m * last, 0.2 * price), 5 * price) AS v FROM (SELECT *, unnest(list_filter([pe1, pe2], lambda q: q IS NOT NULL)) AS m FROM y))
SELECT symbol, price::DOUBLE AS price, round(quantile_cont(v, 0.1), 5) AS p10, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.9), 5) AS p90, round(stddev_pop(v), 5) AS sd FROM z GROUP BY symbol, price"""


def scenario_inputs(spark, d):
    triple = lambda p: F.array(*[F.array(F.col(f"{p}_low") * k, F.col(f"{p}_avg_y") * k, F.col(f"{p}_high_y") * k) for k in (1.0, 1.1, 1.2)])
    return inputs(spark, d).withColumn("rev", triple("rev")).withColumn("eps", triple("eps")).withColumn("rate", F.col("coe")).withColumn("b0", 1.0 + F.col("symbol") % 5).withColumn("b1", F.lit(0.1)).withColumn("b2", F.lit(2.0))


@query("dcf_paths", DCF_SQL)
def dcf_paths(spark, d):
    return rounded(V.dcf(scenario_inputs(spark, d), 3, ("pe1", "pe2")), "p10", "p50", "p90", "sd", n=5)


@query("capm", f"WITH {RETS}, {BENCH}, b AS (SELECT symbol, regr_slope(ret, bench) AS beta, corr(ret, bench) AS rho FROM r JOIN bench USING (date) GROUP BY symbol) SELECT symbol, round(beta, 6) AS beta, round(0.038 + beta * (0.09 - 0.038), 6) AS exp_return, round(abs(beta * 0.16 / CASE WHEN rho IS NULL OR rho = 0 THEN 1 ELSE rho END), 6) AS volatility FROM b")
def capm(spark, d):
    r = weekly_returns(spark, d)
    return rounded(V.capm(r, benchmark(r), 0.16, 0.038, 0.09), "beta", "exp_return", "volatility")


@query("cost_of_capital", f"WITH {INPUT_SQL}, {ANALYST}, c AS (SELECT symbol, coalesce(beta, 1.0) / (1 + (1 - 0.2) * coalesce(d_to_e, 0.5)) AS u FROM analyst) SELECT symbol, round(u, 6) AS unlevered, round(u * (1 + 0.75 * 0.6), 6) AS relevered, round(greatest(0.038 + greatest(u * (1 + 0.75 * 0.6) * 0.05, 0) + g, 0.06), 6) AS coe, round((greatest(0.038 + greatest(u * (1 + 0.75 * 0.6) * 0.05, 0) + g, 0.06) * price + 0.04 * (1 - 0.2) * bvps) / (price + bvps), 6) AS wacc FROM c JOIN inputs USING (symbol)")
def cost_of_capital(spark, d):
    rows = inputs(spark, d).join(analyst(spark, d).select("symbol", F.coalesce("beta", F.lit(1.0)).alias("beta"), F.coalesce("d_to_e", F.lit(0.5)).alias("d_to_e")), "symbol")
    rows = rows.withColumn("unlevered", V.unlever(F.col("beta"), F.lit(0.2), F.col("d_to_e"))).withColumn("relevered", V.relever(F.col("unlevered"), F.lit(0.25), F.lit(0.6)))
    rows = rows.withColumn("coe", V.cost_of_equity(F.col("relevered"), F.lit(0.038), F.lit(0.05), F.col("g")))
    rows = rows.withColumn("wacc", V.wacc(F.col("coe"), F.col("price"), V.cost_of_debt(F.lit(4.0), F.lit(0.2)), F.col("bvps")))
    return rounded(rows.select("symbol", "unlevered", "relevered", "coe", "wacc"), "unlevered", "relevered", "coe", "wacc")


SENT = f"(x / sqrt(x * x + 15.0))"
LEX = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in X.LEXICON.items()) + "}"
WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
TICKERS = f"list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[A-Z]{{2,5}}') AND t NOT IN ({', '.join(repr(t) for t in X.NOT_TICKERS)}))"


@query("ticker_mentions", f"""WITH s AS (SELECT doc_id, list_sum(list_transform({WORDS_SQL}, lambda t: coalesce({LEX}[t], 0))) AS x, list_filter({WORDS_SQL}, lambda w: w NOT IN ({', '.join(repr(w) for w in X.STOP)})) AS w, unnest({TICKERS}) AS ticker FROM documents),
m AS (SELECT ticker, count(*) AS mentions, avg(coalesce({SENT}, 0)) AS a, stddev_pop(coalesce({SENT}, 0)) AS sd FROM s GROUP BY 1), c AS (SELECT ticker, word, count(*) AS n FROM (SELECT ticker, unnest(w) AS word FROM s) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, word) AS r FROM c), l AS (SELECT ticker, string_agg(word, ', ' ORDER BY r) AS top_words FROM t WHERE r <= 3 GROUP BY 1)
SELECT ticker, mentions, round(a, 6) AS avg_sentiment, round(sd, 6) AS sentiment_std, top_words FROM m LEFT JOIN l USING (ticker)""")
def ticker_mentions(spark, d):
    return rounded(X.mentions(parquet(spark, d, "documents")), "avg_sentiment", "sentiment_std")


@query("ticker_counts", f"WITH t AS (SELECT doc_id, unnest({TICKERS}) AS ticker FROM documents) SELECT ticker, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1")
def ticker_counts(spark, d):
    docs = parquet(spark, d, "documents")
    rows = docs.select("doc_id", F.explode(X.tickers(F.col("text"))).alias("ticker"))
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("docs"))


@query("conversation_sentiment", f"WITH w AS (SELECT conv_id, turn, list_sum(list_transform({WORDS_SQL}, lambda t: coalesce({LEX}[t], 0))) AS x FROM conversations) SELECT conv_id, count(*) AS turns, round(avg(coalesce({SENT}, 0)), 6) AS sentiment FROM w GROUP BY 1")
def conversation_sentiment(spark, d):
    c = parquet(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), R(F.avg(F.coalesce(X.sentiment(F.col("text")), F.lit(0.0))), 6).alias("sentiment"))


@query("page_links", "SELECT page_id, len(regexp_extract_all(html, '<a\\s', 0)) AS links FROM pages")
def page_links(spark, d):
    return parquet(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(<a\s)"), 1)).cast("long").alias("links"))

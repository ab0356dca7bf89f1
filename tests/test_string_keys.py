"""Every per-symbol kernel over string symbols gives what it gives over numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import panel as P
from quantloom.operators import calibration as K
from quantloom.operators import estimators as E
from quantloom.operators import forecast as X
from quantloom.operators import holdings as O
from quantloom.operators import indicators as I
from quantloom.operators import metrics as M
from quantloom.plans.performance import benchmark, weekly_returns
from quantloom.sources.tables import bars


def few(df):
    return df.filter(F.col("symbol") <= 4)


def panel(r):
    w = P.over("symbol")
    return r.select("symbol", "date", "ret", F.lag("ret").over(w).alias("l1"), F.lead("ret").over(w).alias("target"))


FITS = {
    "alpha_hac": lambda r, b: M.alpha_hac(r, benchmark(r)),
    "ewm_sharpe": lambda r, b: M.ewm_sharpe(r),
    "betas": lambda r, b: E.betas(r, benchmark(r)),
    "factor_regression": lambda r, b: E.factor_regression(r.withColumn("f", F.sin("ret")), ["f"], {"f": 0.05}).drop("loadings"),
    "covariances": lambda r, b: M.covariances(r).withColumnRenamed("a", "symbol").drop("b"),
    "volatility": lambda r, b: X.volatility_models(r),
    "trend": lambda r, b: X.trend_forecasts(b),
    "quantiles": lambda r, b: X.direct_quantiles(panel(r), ["ret", "l1"]),
    "calibrate": lambda r, b: K.calibrate(b, K.GRIDS | {"rsi": {"window": [14], "low": [30], "high": [70]}, "mfi": {"window": [14], "low": [20], "high": [80]}, "atr": {"window": [14], "break": [20], "mult": [1.5]}}),
    "exponential": lambda r, b: I.exponential(b).drop("seq"),
}


@pytest.mark.parametrize("name", FITS)
def test_string_symbols(spark, name):
    d = "/root/testdata/sf0.01"
    r, b = few(weekly_returns(spark, d)), few(bars(spark, d))
    text = lambda df: df.withColumn("symbol", F.concat(F.lit("T."), F.col("symbol").cast("string")))
    key = lambda rows, strip: sorted((tuple(str(v)[2:] if strip and c == "symbol" else str(round(v, 8) if isinstance(v, float) else v) for c, v in row.asDict().items()) for row in rows))
    want, got = FITS[name](r, b), FITS[name](text(r), text(b))
    assert dict(got.dtypes)["symbol"] == "string"
    assert key(want.collect(), False) == key(got.collect(), True)


def test_string_symbols_of_seeded_fits(spark):
    d = "/root/testdata/sf0.01"
    r = few(weekly_returns(spark, d)).filter("ret IS NOT NULL").withColumn("symbol", F.concat(F.lit("T."), F.col("symbol").cast("string")))
    assert {x["symbol"] for x in X.joint_paths(r, sims=50).collect()} == {"T.0", "T.1", "T.2", "T.3", "T.4", "*"}
    assert {x["a"] for x in E.shrunk_covariances(r).collect()} == {"T.0", "T.1", "T.2", "T.3", "T.4"}
    params = r.groupBy("symbol").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sigma")).withColumns({"skew": F.lit(0.0), "kurt": F.lit(3.0), "price": F.lit(10.0)})
    assert X.gbm_terminal(spark, params, 50, 4).count() == 5
    with pytest.raises(ValueError, match="5 assets"):
        O.allocations(spark, r, benchmark(r), most_assets=3)


def plain_backtest(buy, sell, ret):
    pos, out = 0, []
    for t in range(len(ret)):
        if t:
            out.append(pos * ret[t])
        pos = -1 if sell[t] else 1 if buy[t] else pos
    out = np.array(out)
    return np.sqrt(252) * out.mean() / out.std(ddof=1) if out.std(ddof=1) > 1e-9 else np.nan


def test_sweep_against_plain_backtests():
    rng = np.random.default_rng(3)
    ret = np.append(np.nan, rng.normal(0, 0.02, 119))
    v = 50 + 30 * np.sin(np.arange(120) / 5) + rng.normal(0, 8, 120)
    low, high = np.array([20.0, 30.0, 45.0]), np.array([55.0, 70.0, 95.0, 200.0])
    got = K.sweep(K.crossings(v[:, None], low[None, :])[0][:, :, None], K.crossings(v[:, None], high[None, :])[1][:, None, :], ret)
    for i, a in enumerate(low):
        for j, b in enumerate(high):
            buy = [t > 0 and v[t] > a and v[t - 1] <= a for t in range(120)]
            sell = [t > 0 and v[t] < b and v[t - 1] >= b for t in range(120)]
            np.testing.assert_allclose(got[i, j], plain_backtest(buy, sell, ret), rtol=1e-9)


def test_full_grids_are_the_surveyed_ones():
    size = {n: int(np.prod([len(list(v)) for v in g.values()])) for n, g in K.GRIDS.items()}
    assert size == {"rsi": 26 * 96 * 98, "mfi": 26 * 96 * 98, "bb": 26 * 45, "atr": 26 * 21 * 45, "stoch": 96 * 98, "ema": 16 * 21, "macd": 9 * 14 * 6, "vwap": 35, "obv": 35}

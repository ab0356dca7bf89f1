"""Scoring rules and forecast blending.

A score is one SQL expression over a symbol's fundamentals (NULL reads as the neutral value the rule names), so all scores are
one projection. Cross-sectional cut-offs come from one-row aggregates. Blending is inverse-variance with caps per model
and per model group; the caps are water-filled per symbol in a grouped kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import grouped as G

#: Limits of single models and groups of models, and of inputs.
MAX_MODEL, LEAST_SE, RETURN_CLIP, SE_CLIP = 0.10, 0.02, (-0.8, 4.0), (0.01, 2.0)


def b(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def z(col: str) -> str:
    return f"coalesce({col}, 0)"


def compare(x: str, y: str) -> str:
    """+1 above, -1 below."""
    return f"({b(f'{x} > {y}')} - {b(f'{x} < {y}')})"


SHORT, PRIOR = "coalesce(shares_short / nullif(shares_out, 0), 0)", "coalesce(shares_short_prior / nullif(shares_out, 0), 0)"
PEG = "coalesce(coalesce(price / nullif(forward_eps, 0), 0) / nullif(earnings_growth * 100, 0), 0)"
TRAILING = "CASE WHEN coalesce(trailing_eps, 0) <> 0 THEN price / trailing_eps ELSE 1e300 END"
FORWARD = "CASE WHEN coalesce(forward_eps, 0) <> 0 THEN price / forward_eps ELSE 1e300 END"
ACCRUALS = "coalesce((coalesce(net_income, 0) - coalesce(ocf, 0)) / nullif(revenue / nullif(asset_turnover, 0), 0), 0)"
YIELD = "(coalesce(div_yield, 0) - coalesce(net_issuance / nullif(mcap, 0), 0))"


def capture(up: str, down: str) -> str:
    return (
        f"({b(f'{up} > 1.5 AND {down} < 0.5')} + {b(f'{up} > 1.0 AND {down} < 1.0')} + {b(f'{up} > 1.0 AND {down} < 0.5')} + {b(f'{up} > 1.5 AND {down} < 1.0')}"
        f" + {b(f'{down} < 0')} - {b(f'{down} > 1.0 AND {up} < {down}')} - {b(f'{down} > 1.5 AND {up} < {down}')})"
    )


#: name -> expression. Where later rules overrule earlier ones, the CASE tests the last first.
RULES: dict[str, str] = {
    "short": f"-{b(f'{SHORT} >= short_p75 AND {SHORT} IS NOT NULL')} - {b(f'shares_short_prior > 0 AND {SHORT} >= 1.05 * {PRIOR}')} + {b(f'{SHORT} <= 0.95 * {PRIOR}')}",
    "social": f"{b('sentiment > 0')} + {b('sentiment > 0 AND mentions > 4')} + {b('sentiment > 0.2 AND mentions > 4')} + {b('sentiment > 0.2 AND mentions > 10')} - {b('sentiment < 0')} - {b('sentiment < 0 AND mentions > 4')} - {b('sentiment < -0.2 AND mentions > 4')} - {b('sentiment < -0.2 AND mentions > 10')}",
    "earnings_growth": f"{compare(z('earnings_growth'), '0')} + {b(z('earnings_growth') + ' > growth_p75')} + {b(z('earnings_growth') + ' > ' + z('ind_earnings_growth'))} - {compare(z('trailing_eps'), z('eps_pred'))}",
    "operating_cash_flow": b("ocf > 0"),
    "revenue_growth": f"(CASE WHEN {z('revenue_growth')} <> 0 THEN {compare(z('revenue_growth'), z('ind_revenue_growth'))} ELSE 0 END) - {compare(z('revenue'), z('revenue_pred'))}",
    "return_on_equity": f"(CASE WHEN {z('roe')} <> 0 THEN {compare(z('roe'), z('ind_roe'))} + {b('roe > 0')} ELSE 0 END)",
    "return_on_assets": f"(CASE WHEN {z('roa')} <> 0 THEN {compare(z('roa'), '0')} + {compare(z('roa'), z('ind_roa'))} + {compare(z('roa'), z('prev_roa'))} ELSE 0 END)",
    "asset_growth_sharpe": f"{b('coalesce(asset_growth / nullif(asset_growth_vol, 0), 0) > 1')} - {b('coalesce(asset_growth / nullif(asset_growth_vol, 0), 0) < 0')}",
    "price_to_book": f"{b('pb > 0 AND pb <= 1')} - {b(z('pb') + ' <= 0')} - {compare(z('pb'), z('ind_pb'))}",
    "earnings_price": f"-{b(f'({TRAILING}) > coalesce(ind_pe, 1e301)')} - {compare(f'({FORWARD})', f'({TRAILING})')}",
    "peg": f"(CASE WHEN {PEG} < 0 THEN -1 WHEN {PEG} > 2 THEN -1 WHEN {PEG} > 0 AND {PEG} < 1 THEN 1 ELSE 0 END)",
    "capture": f"{capture('up_slope', 'down_slope')} + {capture('up_ratio', 'down_ratio')}",
    "low_target": b("low_target > price"),
    "recommendation": "(CASE lower(recommendation) WHEN 'strong_buy' THEN 3 WHEN 'hold' THEN -1 WHEN 'sell' THEN -10 WHEN 'strong_sell' THEN -10 ELSE 0 END)",
    "insiders": "(CASE WHEN insider_purchases > 0 THEN 2 WHEN insider_purchases < 0 THEN -1 ELSE 0 END)",
    "net_income": b("net_income > 0"),
    "cash_over_income": b("ocf > net_income"),
    "long_debt": b("coalesce(prev_long_debt, 1e300) > coalesce(long_debt, 1e300)"),
    "current_ratio": b("current_ratio > prev_current_ratio"),
    "beta": "(CASE WHEN coalesce(beta, 1.0) > 1.5 THEN -1 WHEN coalesce(beta, 1.0) < 1.0 THEN 1 ELSE 0 END)",
    "volatility_trend": "(CASE WHEN vol_short < 0.5 * vol_long THEN 1 WHEN vol_short > vol_long THEN -1 ELSE 0 END)",
    "no_new_shares": b("shares_issued <= 0"),
    "debt_to_equity": "(CASE WHEN d_to_e > 4 THEN -2 WHEN d_to_e > 2 THEN -1 WHEN d_to_e > 0 AND d_to_e < 1 THEN 1 ELSE 0 END)",
    "gross_margin": b("gross_margin > prev_gross_margin"),
    "gross_profitability": "(CASE WHEN coalesce(gross_margin * asset_turnover, 0) < 0.10 THEN -1 WHEN gross_margin * asset_turnover > 0.45 THEN 1 ELSE 0 END)",
    "asset_growth_anomaly": "(CASE WHEN coalesce(asset_growth, 0) < 0.05 THEN 1 WHEN asset_growth > 0 THEN -1 ELSE 0 END)",
    "shareholder_yield": f"(CASE WHEN coalesce(net_issuance / nullif(mcap, 0), 0) > yield_unit * 0.05 THEN -1 WHEN {YIELD} > yield_unit * 0.08 THEN 2 WHEN {YIELD} > yield_unit * 0.05 THEN 1 ELSE 0 END)",
    "accruals": f"(CASE WHEN {ACCRUALS} < 0 THEN 1 WHEN {ACCRUALS} > 0.10 THEN -1 ELSE 0 END)",
    "asset_turnover": b("asset_turnover > prev_asset_turnover"),
    "skewness": f"{compare(z('skew'), '0')}",
    "kurtosis": f"{b(z('kurt') + ' < 3.5')} - {b('kurt > 5')} - {b('kurt > 10')}",
    "sharpe": f"(CASE WHEN {z('sharpe')} > 1 THEN 1 WHEN {z('sharpe')} <= 0 THEN -1 ELSE 0 END)",
    "sortino": f"(CASE WHEN {z('sortino')} > 1 THEN 1 WHEN {z('sortino')} <= 0 THEN -1 ELSE 0 END)",
    "signals": z("signal_score"),
    "alpha": f"{compare(z('alpha'), '0')} - 5 * {b('pred_alpha < 0')}",
    "eps_revisions": "greatest(least(coalesce(2 * eps_rev_7 + eps_rev_30, 0), 5), -5)",
}


def with_cutoffs(f: DataFrame) -> DataFrame:
    """The 75th percentiles of the non-zero short ratios and growths, and the unit of yields (percent where the greatest
    exceeds 5)."""
    short, growth = F.expr(SHORT), F.coalesce("earnings_growth", F.lit(0.0))
    one = f.agg(F.percentile(F.when(short != 0, short), F.lit(0.75)).alias("short_p75"), F.coalesce(F.percentile(F.when(growth != 0, growth), F.lit(0.75)), F.lit(1e300)).alias("growth_p75"), F.when(F.max("div_yield") > 5, 100.0).otherwise(1.0).alias("yield_unit"))
    return f.crossJoin(F.broadcast(one))  # one row


def score(fundamentals: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    rows = with_cutoffs(fundamentals)
    out = rows.select("symbol", *[F.expr(e).cast("int").alias(f"s_{n}") for n, e in rules.items()])
    return out.withColumn("score", sum((F.col(f"s_{n}") for n in rules), F.lit(0)))


def valid() -> F.Column:
    return F.col("ret").isNotNull() & ~F.col("ret").isin(-1.0, 0.0) & (F.col("se") > LEAST_SE)


def blend(models: DataFrame, yield_sd: F.Column | None = None) -> DataFrame:
    """Inverse-variance mean of (symbol, model, ret, se), with within- and between-model variance; no caps."""
    r = F.least(F.greatest("ret", F.lit(RETURN_CLIP[0])), F.lit(RETURN_CLIP[1]))
    s = F.least(F.greatest("se", F.lit(SE_CLIP[0])), F.lit(SE_CLIP[1]))
    rows = models.filter(valid()).select("symbol", r.alias("r"), s.alias("s"), (1 / (s * s)).alias("i"))
    sums = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("si"), F.sum(F.col("i") * F.col("r")).alias("sr"), F.sum(F.col("i") * F.col("r") * F.col("r")).alias("srr"))
    mean = F.col("sr") / F.col("si")
    between = F.col("srr") / F.col("si") - mean * mean
    return sums.select("symbol", "n", mean.alias("ret"), F.sqrt(F.least(F.greatest(1 / F.col("si") + between, F.lit(SE_CLIP[0] ** 2)), F.lit(SE_CLIP[1] ** 2))).alias("se"))


def water_fill(w: np.ndarray, add: np.ndarray, need: float, cap: float, pref: np.ndarray) -> None:
    """Deals ``need`` over the marked weights in proportion to pref, none over the cap."""
    while need > 1e-10:
        open_ = add & (cap - w > 1e-10)
        if not open_.any():
            return
        step = np.minimum(need * pref[open_] / pref[open_].sum(), cap - w[open_])
        w[open_] += step
        need -= step.sum()


def capped_weights(raw: np.ndarray, cap: float, groups: list[tuple[np.ndarray, float]], passes: int = 30) -> np.ndarray:
    """Weights capped singly, deficits dealt out by room, then group limits enforced until they settle."""
    w = np.minimum(raw, cap)
    for _ in range(len(w)):
        room = np.maximum(cap - w, 0)
        if 1 - w.sum() <= 1e-8 or room.sum() <= 0:
            break
        w = np.minimum(w + (1 - w.sum()) * room / room.sum(), cap)
    w = w / w.sum()
    pref = np.where(raw > 0, raw, 1.0)
    for _ in range(passes):
        before = w.copy()
        for inside, limit in groups:
            total, room = w[inside].sum(), np.maximum(cap - w[~inside], 0).sum()
            if total <= limit + 1e-10 or room <= 1e-10:
                continue
            goal = max(limit, total - room)
            if goal < total:
                w[inside] *= goal / total
                water_fill(w, ~inside, total - goal, cap, pref)
        if np.abs(w - before).max() < 1e-10:
            break
    return w


def capped_blend(models: DataFrame, groups: dict[str, tuple[list[str], float]], yield_sd: str | None = None) -> DataFrame:
    """As ``blend``, with at most max(0.10, 1/n) on a model and limits on groups of models."""
    cols = ["symbol", "model", "ret", "se"] + ([yield_sd] if yield_sd else [])

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        r, s = x["ret"].clip(*RETURN_CLIP).to_numpy(), x["se"].clip(*SE_CLIP).to_numpy()
        i = 1 / s**2
        names = x["model"].to_numpy()
        limits = [(np.isin(names, members), limit) for members, limit in groups.values()]
        w = capped_weights(i / i.sum(), max(MAX_MODEL, 1 / len(x)), [(m, v) for m, v in limits if m.any() and not m.all()])
        mean = float(w @ r)
        extra = float(x[yield_sd].iloc[0] ** 2) if yield_sd else 0.0
        var = min(max(float(w**2 @ s**2 + w @ (r - mean) ** 2) + extra, SE_CLIP[0] ** 2), SE_CLIP[1] ** 2)
        return [(symbol, len(x), mean, var**0.5, float(w.max()))]

    return G.per_symbol(models.filter(valid()).select(*cols), "symbol", "model", "symbol {key}, n long, ret double, se double, max_weight double", run)


def bull_bear(blended: DataFrame, k: float = 1.96) -> DataFrame:
    return blended.withColumn("bear", F.greatest(F.col("ret") - k * F.col("se"), F.lit(RETURN_CLIP[0]))).withColumn("bull", F.least(F.col("ret") + k * F.col("se"), F.lit(RETURN_CLIP[1])))


def forecast_weights(models: DataFrame) -> DataFrame:
    """Long table of inverse-variance weights per symbol and model."""
    from pyspark.sql import Window

    i = 1 / F.pow(F.least(F.greatest("se", F.lit(SE_CLIP[0])), F.lit(SE_CLIP[1])), F.lit(2))
    return models.filter(valid()).select("symbol", "model", (i / F.sum(i).over(Window.partitionBy("symbol"))).alias("weight"))


def clean_predictions(models: DataFrame) -> DataFrame:
    """Useless predictions (SE up to 0.02, returns at or under the floor, NULL) become 0; others are clipped."""
    bad = F.col("ret").isNull() | F.col("se").isNull() | (F.col("se") <= LEAST_SE) | (F.col("ret") <= RETURN_CLIP[0])
    return models.withColumn("_b", bad).withColumn("ret", F.when(F.col("_b"), 0.0).otherwise(F.least("ret", F.lit(RETURN_CLIP[1])))).withColumn("se", F.when(F.col("_b"), 0.0).otherwise(F.least("se", F.lit(SE_CLIP[1])))).drop("_b")

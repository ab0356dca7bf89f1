"""Performance and risk metrics of return panels (symbol, date, ret), one wide aggregation where the metric allows.

Conventions: deviations have ddof 1 unless named population; kurtosis is raw (3 for a normal); drawdowns start at the first
wealth; counts of periods include rows without a return.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantloom.functions import grouped as G
from quantloom.functions import panel as P
from quantloom.functions import special as S
from quantloom.sources.tables import stored

#: Annual risk-free rate and its weekly root, periods in a year.
RF = 0.038
WEEKS = 52
RF_WEEK = (1 + RF) ** (1 / WEEKS) - 1


def annual_return(r: str = "ret", periods: int = WEEKS) -> Column:
    """prod(1 + r)^(periods / rows) - 1; 0 for a row or less."""
    n = F.count(F.lit(1))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(r)) * periods / n) - 1)


def annual_vol(r: str = "ret", periods: int = WEEKS) -> Column:
    return F.stddev_samp(r) * math.sqrt(periods)


def skew(r: str = "ret") -> Column:
    return F.when(F.stddev_pop(r) == 0, F.lit(0.0)).otherwise(F.skewness(r))


def kurt(r: str = "ret") -> Column:
    return F.when(F.stddev_pop(r) == 0, F.lit(3.0)).otherwise(F.kurtosis(r) + 3)


def cornish_fisher(z: float, s: Column, k: Column) -> Column:
    return z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * (k - 3) / 24 - (2 * z**3 - 5 * z) * s * s / 36


def var_gaussian(r: str = "ret", level: float = 0.05, modified: bool = False) -> Column:
    z = S.norm_ppf(level)
    return -(F.avg(r) + (cornish_fisher(z, skew(r), kurt(r)) if modified else F.lit(z)) * F.stddev_pop(r))


def var_historic(r: str = "ret", level: float = 0.05) -> Column:
    return -F.percentile(r, F.lit(level))


def omega(r: str = "ret", threshold: float = 0.0) -> Column:
    gain, loss = F.sum(F.greatest(F.col(r) - threshold, F.lit(0.0))), F.sum(F.greatest(threshold - F.col(r), F.lit(0.0)))
    return F.when(loss == 0, F.lit(float("inf"))).otherwise(gain / F.when(loss == 0, None).otherwise(loss))


def tail_ratio(r: str = "ret", upper: float = 0.9, lower: float = 0.1) -> Column:
    low = F.percentile(r, F.lit(lower))
    return F.when(low >= 0, F.lit(float("inf"))).otherwise(F.percentile(r, F.lit(upper)) / F.abs(F.when(low == 0, None).otherwise(low)))


def sortino(r: str = "ret", target: float = RF_WEEK, periods: int = WEEKS, downside_only: bool = True) -> Column:
    """Annual excess over annualised semideviation: over the downside rows, or over all rows."""
    d = F.when(F.col(r) < target, F.pow(F.col(r) - target, 2))
    semi = F.sqrt(F.avg(d) if downside_only else F.sum(F.coalesce(d, F.when(F.col(r).isNotNull(), 0.0))) / F.count(r))
    return P.ratio(annual_return(r, periods) - RF, semi * math.sqrt(periods))


def drawdowns(returns: DataFrame, start: float = 1000.0) -> DataFrame:
    """wealth, peak and drawdown by date; the peak starts at the first wealth."""
    w = P.over("symbol")
    rows = returns.filter("ret IS NOT NULL").withColumn("wealth", P.wealth(F.col("ret"), w, start))
    return rows.withColumn("peak", P.cummax(F.col("wealth"), w)).withColumn("drawdown", (F.col("wealth") - F.col("peak")) / F.col("peak"))


def summary(returns: DataFrame, periods: int = WEEKS) -> DataFrame:
    """The plain metrics of every symbol in one pass."""
    mean, sd = F.avg("ret"), F.stddev_samp("ret")
    ann, vol = annual_return("ret", periods), annual_vol("ret", periods)
    return returns.groupBy("symbol").agg(
        F.count("ret").alias("n"), ann.alias("ann_return"), vol.alias("ann_vol"), F.when(vol > 0, (ann - RF) / vol).alias("sharpe"), skew().alias("skew"), kurt().alias("kurtosis"),
        var_gaussian().alias("var_gaussian"), var_gaussian(modified=True).alias("var_modified"), var_historic().alias("var_historic"), omega().alias("omega"), tail_ratio().alias("tail_ratio"),
        sortino().alias("sortino"), sortino(downside_only=False).alias("sortino_all"), F.avg((F.col("ret") > 0).cast("double")).alias("pct_positive"), P.ratio(ann - RF, var_historic()).alias("raroc"), P.ratio(mean, sd).alias("mean_sd"),
    )


def expected_shortfall(returns: DataFrame, level: float = 0.05) -> DataFrame:
    """-mean of the returns at or under -VaR; 0 where none."""
    cut = returns.groupBy("symbol").agg(F.percentile("ret", F.lit(level)).alias("q"))
    rows = returns.join(cut, "symbol")
    return rows.groupBy("symbol").agg(F.coalesce(-F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret"))), F.lit(0.0)).alias("cvar"))


def drawdown_metrics(returns: DataFrame, level: float = 0.05, periods: int = WEEKS) -> DataFrame:
    """Maximum, ulcer and pain indices, conditional drawdown at risk, Calmar and pain ratios."""
    dd = drawdowns(returns)
    agg = dd.groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"), F.sqrt(F.avg(F.pow("drawdown", F.lit(2)))).alias("ulcer"), (-F.avg("drawdown")).alias("pain"), F.percentile("drawdown", F.lit(level)).alias("_q"))
    tail = dd.join(agg.select("symbol", "_q"), "symbol").groupBy("symbol").agg(F.avg(F.when(F.col("drawdown") <= F.col("_q"), F.col("drawdown"))).alias("cdar"))
    ann = returns.groupBy("symbol").agg(annual_return("ret", periods).alias("ann"))
    out = agg.join(tail, "symbol").join(ann, "symbol")
    return out.select("symbol", "max_drawdown", "ulcer", "pain", "cdar", P.ratio(F.col("ann"), F.abs("max_drawdown")).alias("calmar"), P.ratio(F.col("ann") - RF, F.col("pain")).alias("pain_ratio"))


def streaks(returns: DataFrame) -> DataFrame:
    """Share of gains and the longest runs of gains and of losses."""
    rows = returns.filter("ret IS NOT NULL")
    r = P.runs(rows, F.signum("ret").cast("int")).groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("state") > 0, F.col("length"))), F.lit(0)).alias("win_run"), F.coalesce(F.max(F.when(F.col("state") < 0, F.col("length"))), F.lit(0)).alias("loss_run"))
    return rows.groupBy("symbol").agg(F.avg((F.col("ret") > 0).cast("double")).alias("pct_positive")).join(r, "symbol")


def relative(returns: DataFrame, bench: DataFrame, periods: int = WEEKS) -> DataFrame:
    """Against a benchmark (date, bench): beta, alpha, R2, tracking error, information ratio, capture slopes and ratios, M2."""
    rows = returns.join(bench, "date").filter("ret IS NOT NULL AND bench IS NOT NULL")
    y, x = F.col("ret") - RF_WEEK, F.col("bench") - RF_WEEK
    up, down = F.col("bench") > 0, F.col("bench") < 0
    slope = lambda c: F.when(F.count(F.when(c, 1)) >= 3, F.regr_slope(F.when(c, F.col("ret")), F.when(c, F.col("bench"))))
    mean = lambda c, v: F.avg(F.when(c, F.col(v)))
    ann_p, ann_b = annual_return("ret", periods), annual_return("bench", periods)
    te = F.stddev_samp(F.col("ret") - F.col("bench"))
    vol = annual_vol("ret", periods)
    beta = F.regr_slope(y, x)
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), beta.alias("beta"), F.when(F.count(F.lit(1)) >= 5, F.pow(1 + F.regr_intercept(y, x), periods) - 1).alias("alpha"), F.regr_r2(y, x).alias("r2"), te.alias("tracking_error"),
        P.ratio(ann_p - ann_b, te).alias("information_ratio"), P.ratio(ann_p - RF, beta).alias("treynor"), slope(up).alias("up_slope"), slope(down).alias("down_slope"),
        P.ratio(mean(up, "ret"), mean(up, "bench")).alias("up_ratio"), P.ratio(mean(down, "ret"), mean(down, "bench")).alias("down_ratio"), (RF + P.ratio(ann_p - RF, vol) * annual_vol("bench", periods)).alias("m2"),
    )


def hac_lags(n: int) -> int:
    return max(1, int(n**0.25))


def newey_west(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares with a Bartlett-weighted covariance: coefficients, standard errors, residuals."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    xe = x * e[:, None]
    s = xe.T @ xe
    for k in range(1, min(lags, len(y) - 1) + 1):
        g = xe[k:].T @ xe[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.pinv(x.T @ x)
    return beta, np.sqrt(np.maximum(np.diag(inv @ s @ inv), 0)), e


def alpha_hac(returns: DataFrame, bench: DataFrame, periods: int = WEEKS, least: int = 10) -> DataFrame:
    """Alpha and beta with autocorrelation-robust errors, alpha annualised."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        x = x.dropna()
        if len(x) < least:
            return [(symbol, len(x), None, None, None, None, None)]
        y, m = x["ret"].to_numpy() - RF_WEEK, x["bench"].to_numpy() - RF_WEEK
        b, se, e = newey_west(np.column_stack([np.ones(len(m)), m]), y, hac_lags(len(y)))
        r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
        return [(symbol, len(x), float((1 + b[0]) ** periods - 1), float(b[1]), float(r2), float(b[0] / se[0]), float(se[1]))]

    return G.per_symbol(returns.join(bench, "date").select("symbol", "date", "ret", "bench"), "symbol", "date", "symbol {key}, n long, alpha double, beta double, r2 double, alpha_t double, beta_se double", run)


def probabilistic_sharpe(sr: Column, target: Column, n: Column, s: Column, k: Column) -> Column:
    return S.cdf((sr - target) * F.sqrt(n - 1) / F.sqrt(1 - s * sr + (k - 1) / 4 * sr * sr))


def deflated_sharpe(sr: Column, n: Column, s: Column, k: Column, trials: int, sr_sd: Column) -> Column:
    """The probability that a Sharpe ratio beats the best of ``trials`` without skill."""
    return probabilistic_sharpe(sr, sr_sd * S.expected_max_normal(trials), n, s, k)


def predicted_shortfall(mu: Column, sigma: Column, s: Column, k: Column, level: float = 0.05, periods: int = WEEKS) -> Column:
    """One-period expected shortfall from annual mean and deviation with a Cornish-Fisher quantile."""
    z = cornish_fisher(S.norm_ppf(level), s, k)
    return -(mu / periods) + sigma / math.sqrt(periods) * S.phi(z) / level


def holdings_returns(weights: DataFrame, returns: DataFrame, least: float = 0.0) -> DataFrame:
    """(holdings, date, ret): weights over the assets present, renormalised; NULL under the coverage."""
    total = weights.groupBy("holdings").agg(F.sum("weight").alias("_t"))
    rows = weights.join(returns.filter("ret IS NOT NULL"), "symbol").groupBy("holdings", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("_r"), F.sum("weight").alias("_w"))
    rows = rows.join(total, "holdings")
    return rows.select("holdings", "date", F.when(P.ratio(F.col("_w"), F.col("_t")) >= least, P.ratio(F.col("_r"), F.col("_w"))).alias("ret"), P.ratio(F.col("_w"), F.col("_t")).alias("coverage"))


def weighted(weights: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """Sum of weight x value per holdings: beta, tax, leverage, score."""
    return weights.join(values, "symbol").groupBy("holdings").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in cols])


#: Symbols in one block of pairs, at least and at most; up to PAIR_BLOCKS blocks are made before they grow past the least.
PAIR_BLOCK, PAIR_MOST, PAIR_BLOCKS = 128, 8192, 8
#: Pairs of blocks that a plan reads one by one, at most: those of some half a million symbols.
PAIR_READS = 2048
#: Symbols along one side of a tile: the piece of a pair of blocks whose moments are in memory at once.
PAIR_TILE = 1024


class Tile(NamedTuple):
    """Moments of the pairs of ``a`` (rows) and ``b`` (columns): n, cov and corr (NaN where undefined). ``at``: the places of the
    first row and column in their blocks. Where ``same``, both blocks are one, and tiles under its diagonal are left out."""

    a: np.ndarray
    b: np.ndarray
    at: tuple[int, int]
    same: bool
    n: np.ndarray
    cov: np.ndarray
    corr: np.ndarray


class Block(NamedTuple):
    """Symbols in order, deviations from each one's own mean (symbols x dates, 0 where unknown), 1.0 where known, and a value of each."""

    names: np.ndarray
    dev: np.ndarray
    known: np.ndarray
    extra: np.ndarray


def packed(returns: DataFrame, key: str = "symbol", label: str = "pairs") -> DataFrame:
    """(s, dates, rets): the returns of each symbol in order of dates as one row of arrays, in a working table, so that the panel is
    computed once."""
    rows = returns.select(F.col(key).alias("s"), "date", F.col("ret").cast("double").alias("ret")).filter("s IS NOT NULL AND date IS NOT NULL")
    rows = rows.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("x"))
    return stored(returns.sparkSession, rows.select("s", F.col("x.date").alias("dates"), F.col("x.ret").alias("rets")), label, clean=True)


def over_pairs(rows: DataFrame, run: Callable[[object, Iterator[Tile], Block, Block], Iterator[pd.DataFrame]], schema: str, apart: bool = False) -> DataFrame:
    """``run`` over every pair of blocks of symbols. rows: s, dates, rets, and maybe grp (pairs are of one group, never NULL) and extra (double).

    Symbols are dealt into blocks; each pair of blocks is two matrices (symbols x dates) whose products give all their moments
    at once, tile by tile. Rows shuffled are one a symbol and block, never one a pair and date, and nothing holds more than two
    blocks and a tile. The number of symbols of each group is counted first. ``apart`` (rows without grp): more than PAIR_MOST
    symbols are stored by block, and each pair of blocks reads its two, so that no shuffle holds every block's copies at once.
    """
    rows = rows.select("s", "dates", "rets", *[c if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("grp", "int"), ("extra", "double"))])
    sizes = rows.groupBy("grp").agg(F.count("s").alias("n"))
    sizes = sizes.withColumn("k", F.greatest(F.ceil(F.col("n") / PAIR_MOST), F.least(F.ceil(F.col("n") / PAIR_BLOCK), F.lit(PAIR_BLOCKS)), F.lit(1)).cast("int"))
    n, cells, k = sizes.agg(F.sum("n"), F.sum(F.col("k") * (F.col("k") + 1) / 2), F.max("k")).first()
    cells = int(cells or 1)
    parts = min(cells, max(PAIR_BLOCKS * (PAIR_BLOCKS + 1) // 2, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # A group's k blocks are the same wherever it is met: they come from its size alone.
    dealt = rows.join(sizes.select(F.col("grp").alias("_g"), "k"), F.col("grp").eqNullSafe(F.col("_g"))).withColumn("m", F.pmod(F.xxhash64("s"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("i", F.least("m", "o")).withColumn("j", F.greatest("m", "o"))
    place = F.pmod(F.when(F.col("grp").isNull(), 0).otherwise(F.xxhash64("grp")) + (F.col("j") * (F.col("j") + 1) / 2).cast("bigint") + F.col("i"), F.lit(parts)).cast("int")
    dealt = dealt.select("s", "dates", "rets", "grp", "extra", "m", "i", "j", place.alias("to"))
    dealt = dealt.repartitionById(parts, F.col("to")).sortWithinPartitions("grp", "i", "j").drop("to")
    if apart and (n or 0) > PAIR_MOST and cells <= PAIR_READS:
        mine = rows.withColumn("m", F.pmod(F.xxhash64("s"), F.lit(k)).cast("int")).repartitionById(k, F.col("m"))
        blocks = stored(rows.sparkSession, mine, "blocks", clean=True, by=("m",))
        pairs = [blocks.filter(F.col("m").isin(i, j)).withColumns({"i": F.lit(i), "j": F.lit(j)}).coalesce(1) for j in range(k) for i in range(j + 1)]
        # Spark puts a union of single partitions into one task; no block has a number under 0, and these no rows aren't a single partition.
        none = blocks.filter("m < 0").withColumns({"i": F.lit(0), "j": F.lit(0)})
        dealt = reduce(DataFrame.union, [none, *pairs])

    def block(parts: list[pa.RecordBatch], calendar: np.ndarray) -> Block:
        names = [s for p in parts for s in p["s"].to_pylist()]
        names = np.array(names, dtype=object if isinstance(names[0], str) else None) if names else np.empty(0, np.int64)
        extra = np.concatenate([p["extra"].to_numpy(zero_copy_only=False).astype(float) for p in parts]) if parts else np.empty(0)
        at, ranks = np.argsort(names, kind="stable"), np.empty(len(names), np.int64)
        ranks[at] = np.arange(len(names))
        x, known = np.zeros((len(names), len(calendar))), np.zeros((len(names), len(calendar)))
        first = 0
        for p in parts:
            counts = np.diff(p["rets"].offsets.to_numpy())
            row = np.repeat(ranks[first : first + len(counts)], counts)
            col, ret = np.searchsorted(calendar, p["dates"].flatten().to_numpy(zero_copy_only=False)), p["rets"].flatten().to_numpy(zero_copy_only=False)
            x[row, col] = ret
            known[row, col] = 1.0
            if known[ranks[first : first + len(counts)]].sum() != len(ret):
                raise ValueError("a symbol has two returns on one date")
            first += len(counts)
        known[np.isnan(x)] = 0.0
        x[np.isnan(x)] = 0.0
        # Deviations from each symbol's own mean keep the sums small; pairs correct for their common dates.
        x = np.where(known > 0, x - x.sum(1, keepdims=True) / np.maximum(known.sum(1, keepdims=True), 1), 0.0)
        return Block(names[at], x, known, extra[at])

    def tiles(u: Block, v: Block, same: bool) -> Iterator[Tile]:
        for a in range(0, len(u.names), PAIR_TILE):
            x, fx = u.dev[a : a + PAIR_TILE], u.known[a : a + PAIR_TILE]
            for b in range(a if same else 0, len(v.names), PAIR_TILE):
                y, fy = v.dev[b : b + PAIR_TILE].T, v.known[b : b + PAIR_TILE].T
                n = fx @ fy
                sx, sy = x @ fy, fx @ y
                with np.errstate(divide="ignore", invalid="ignore"):
                    cov = (x @ y - sx * sy / n) / (n - 1)
                    corr = cov / np.sqrt(((x * x) @ fy - sx * sx / n) / (n - 1) * ((fx @ (y * y) - sy * sy / n) / (n - 1)))
                yield Tile(u.names[a : a + PAIR_TILE], v.names[b : b + PAIR_TILE], (a, b), same, n, cov, corr)

    def cell(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, i, j = key
        calendar = np.unique(np.concatenate([p["dates"].flatten().to_numpy(zero_copy_only=False) for p in parts]))
        mine = [[p.filter(pc.equal(p["m"], pa.scalar(k, pa.int32()))) for p in parts] for k in {i: 0, j: 0}]
        parts.clear()
        one = [block([p for p in m if len(p)], calendar) for m in mine]
        u, v = one[0], one[-1]
        for out in run(group, tiles(u, v, i == j), u, v):
            yield pa.RecordBatch.from_pandas(out, arrow, preserve_index=False)

    def all_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch[c].to_pylist() for c in ("grp", "i", "j")), strict=True))
            cuts = [0, *[t for t in range(1, len(keys)) if keys[t] != keys[t - 1]], len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if keys[a] != now and held:
                    yield from cell(now, held)
                    held = []
                now = keys[a]
                held.append(batch.slice(a, z - a))
        if held:
            yield from cell(now, held)

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return dealt.mapInArrow(all_cells, schema)


def covariances(*returns: DataFrame, key: str = "symbol") -> DataFrame:
    """(a, b, cov, corr, n), a <= b, over the dates both have. Returns may come in several tables, each with the whole histories of its
    symbols; they are packed one after the other."""

    def run(_, tiles: Iterator[Tile], u: Block, v: Block) -> Iterator[pd.DataFrame]:
        for t in tiles:
            known = t.n > 0
            if t.same and t.at[0] == t.at[1]:
                known = np.triu(known)
            # Some rows of a tile at a time: a table of its pairs takes more room than its moments.
            for r in range(0, len(t.a), 128):
                p, q = np.nonzero(known[r : r + 128])
                p += r
                a, b = t.a[p], t.b[q]
                low = a <= b
                yield pd.DataFrame({"a": np.where(low, a, b), "b": np.where(low, b, a), "cov": t.cov[p, q], "corr": t.corr[p, q], "n": t.n[p, q].astype(np.int64)})

    kind = returns[0].schema[key].dataType.simpleString()
    table = reduce(DataFrame.union, [packed(r, key) for r in returns])
    out = over_pairs(table, run, f"a {kind}, b {kind}, cov double, corr double, n bigint", apart=True)
    return out.select("a", "b", P.clean("cov").alias("cov"), P.clean("corr").alias("corr"), "n")


def holdings_volatility(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """sqrt(w' S w) from the upper triangle."""
    a = weights.select("holdings", F.col("symbol").alias("a"), F.col("weight").alias("wa"))
    b = weights.select("holdings", F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    rows = cov.join(a, "a").join(b, ["holdings", "b"])
    return rows.groupBy("holdings").agg(F.sqrt(F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("wa") * F.col("wb") * F.col("cov"))).alias("volatility"))


def holdings_risk(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """sqrt(w' S w) over the covariances of the dates both symbols of a pair have. Only pairs within one holdings are computed, and
    each pair of blocks gives one number, so no pair becomes a row."""

    def run(group, tiles: Iterator[Tile], u: Block, v: Block) -> Iterator[pd.DataFrame]:
        total, any_pair, any_cov = 0.0, False, False
        for t in tiles:
            good = np.isfinite(t.cov)
            any_pair, any_cov = any_pair or bool((t.n > 0).any()), any_cov or bool(good.any())
            wa, wb = u.extra[t.at[0] : t.at[0] + len(t.a)], v.extra[t.at[1] : t.at[1] + len(t.b)]
            part = float(wa @ np.where(good, t.cov, 0.0) @ wb)
            total += part if t.same and t.at[0] == t.at[1] else 2 * part
        if any_pair:
            yield pd.DataFrame({"holdings": [group], "v": [total if any_cov else None]})

    w = weights.filter("weight IS NOT NULL").groupBy("holdings", "symbol").agg(F.sum("weight").cast("double").alias("extra"))
    rows = packed(returns).join(w.select(F.col("symbol").alias("s"), F.col("holdings").alias("grp"), "extra"), "s").filter("grp IS NOT NULL")
    out = over_pairs(rows, run, f"holdings {weights.schema['holdings'].dataType.simpleString()}, v double")
    return out.groupBy("holdings").agg(F.sqrt(F.sum("v")).alias("volatility"))


def most_correlated(table: DataFrame, k: int = 5, least: int = 30) -> DataFrame:
    """(src, dst, rho): of each symbol the k others with the largest |correlation| (of equal ones the first) over at least ``least``
    dates. table: as ``packed`` gives it. Each pair of blocks keeps k a symbol, so at most k x blocks rows of a symbol are shuffled."""

    def run(_, tiles: Iterator[Tile], u: Block, v: Block) -> Iterator[pd.DataFrame]:
        sides = [(u.names, v.names)] + ([] if u is v else [(v.names, u.names)])
        floor = [np.full(len(mine), -np.inf) for mine, _ in sides]
        held: list[list[tuple]] = [[] for _ in sides]
        count = [0] * len(sides)

        def cut(side: int) -> None:
            """Keep each symbol's k best of what is held, and the least |correlation| that could still enter."""
            src, dst, rho = (np.concatenate(c) for c in zip(*held[side], strict=True))
            at = np.lexsort((dst, -np.abs(rho), src))
            src, dst, rho = src[at], dst[at], rho[at]
            start = np.r_[0, np.flatnonzero(np.diff(src)) + 1]
            rank = np.arange(len(src)) - np.repeat(start, np.diff(np.r_[start, len(src)]))
            full = rank == k - 1
            floor[side][src[full]] = np.abs(rho[full])
            keep = rank < k
            held[side][:] = [(src[keep], dst[keep], rho[keep])]
            count[side] = int(keep.sum())

        def take(side: int, size: np.ndarray, rho: np.ndarray, at: tuple[int, int]) -> None:
            """size: |correlation|, -inf where there is none, a row a symbol of this side."""
            least_of = floor[side][at[0] : at[0] + len(size)]
            if size.shape[1] > k and np.isinf(least_of).any():
                least_of = np.maximum(least_of, np.partition(size, size.shape[1] - k, axis=1)[:, size.shape[1] - k])
            p, q = np.nonzero((size >= least_of[:, None]) & (size > -np.inf))
            if len(p):
                held[side].append((p + at[0], q + at[1], rho[p, q]))
                count[side] += len(p)
                if count[side] > 4 * k * len(sides[side][0]) + 1_000_000:
                    cut(side)

        for t in tiles:
            size = np.where((t.n >= least) & np.isfinite(t.corr), np.abs(t.corr), -np.inf)
            diagonal = t.same and t.at[0] == t.at[1]
            if diagonal:
                np.fill_diagonal(size, -np.inf)
            take(0, size, t.corr, t.at)
            if not diagonal:
                take(0 if t.same else 1, size.T, t.corr.T, t.at[::-1])
            for side in range(len(sides)):
                if held[side]:
                    cut(side)
        for (mine, others), rows in zip(sides, held, strict=True):
            for src, dst, rho in rows:
                yield pd.DataFrame({"src": mine[src], "dst": others[dst], "rho": rho})

    kind = table.schema["s"].dataType.simpleString()
    best = over_pairs(table, run, f"src {kind}, dst {kind}, rho double")
    return P.top_k(best, ["src"], [F.abs("rho").desc(), F.col("dst")], k)


def ewm_sharpe(returns: DataFrame, periods: int = WEEKS, share: float = 0.1) -> DataFrame:
    """Annualised Sharpe of exponentially weighted moments, halflife a tenth of the history."""

    def run(symbol, x: pd.DataFrame) -> list[tuple]:
        r = x["ret"].dropna().to_numpy()
        if len(r) < 3:
            return [(symbol, None, None, None)]
        a = G.alpha_of(halflife=share * len(r))
        m, s = G.ewm_mean(r, a)[-1], G.ewm_std(r, a)[-1]
        return [(symbol, float(m * periods), float(s * np.sqrt(periods)), float((m * periods - RF) / (s * np.sqrt(periods))) if s > 0 else None)]

    return G.per_symbol(returns.select("symbol", "date", "ret"), "symbol", "date", "symbol {key}, ewm_return double, ewm_vol double, ewm_sharpe double", run)


def report(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """All metrics of each symbol or holdings side by side."""
    out = summary(returns)
    for part in (expected_shortfall(returns), drawdown_metrics(returns), streaks(returns).drop("pct_positive"), relative(returns, bench).drop("n")):
        out = out.join(part, "symbol", "left")
    return out


def capacity(assets: DataFrame, a: float = 0.5, b: float = 0.5, c: float = 0.5, d: float = 0.5, e: float = 0.25, h: float = 1.0, cap: float = 0.08, floor: float = 0.0, sector_cap: float = 0.15) -> DataFrame:
    """Weight bounds from size, forecast, risk and liquidity, capped per asset and sector.

    assets: symbol, sector, mcap, score, er, r2, vol, adv, amihud. The raw capacity is winsorised, shared out within all
    eligible assets, scaled back in sectors over their cap, and what caps take is dealt out once over the headroom.
    """
    raw = F.pow("mcap", F.lit(a)) * (1 + F.pow(F.greatest("score", F.lit(0.0)), F.lit(b)) * F.pow(F.greatest("r2", F.lit(0.0)), F.lit(c))) / F.pow("vol", F.lit(d)) * F.pow("adv", F.lit(e)) / (1 + h * F.col("amihud"))
    rows = assets.withColumn("_c", F.when((F.col("er") > 0) & (F.col("score") > 0), raw).otherwise(F.lit(0.0)))
    ends = rows.filter("_c > 0").agg(F.percentile("_c", F.lit(0.05)).alias("_l"), F.percentile("_c", F.lit(0.95)).alias("_h"))  # one row
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("_c", F.when(F.col("_c") > 0, P.clip(F.col("_c"), F.col("_l"), F.col("_h"))).otherwise(0.0))
    total = rows.agg(F.sum("_c").alias("_t"))  # one row
    rows = rows.crossJoin(F.broadcast(total)).withColumn("_w", P.ratio(F.col("_c"), F.col("_t")))
    by = Window.partitionBy("sector")
    rows = rows.withColumn("_s", F.sum("_w").over(by)).withColumn("_w", F.when(F.col("_s") > sector_cap, F.col("_w") * sector_cap / F.col("_s")).otherwise(F.col("_w")))
    rows = rows.withColumn("_u", F.least(F.col("_w"), F.lit(cap))).withColumn("_room", F.when(F.col("_c") > 0, cap - F.col("_u")).otherwise(0.0))
    left = rows.agg((1 - F.sum("_u")).alias("_left"), F.sum("_room").alias("_rooms"))  # one row
    rows = rows.crossJoin(F.broadcast(left)).withColumn("upper", F.col("_u") + F.greatest(F.lit(0.0), F.least(F.col("_room"), P.ratio(F.col("_room"), F.col("_rooms")) * F.greatest(F.col("_left"), F.lit(0.0)))))
    return rows.select("symbol", "sector", F.when(F.col("_c") > 0, F.lit(floor)).otherwise(0.0).alias("lower"), F.coalesce("upper", F.lit(0.0)).alias("upper"))

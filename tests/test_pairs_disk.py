"""What covariances keep on disk beside their rows: one shuffle of some symbols' lines at a time, and none of the blocks."""

import datetime

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import metrics as M
from quantloom.plans import performance
from quantloom.plans.performance import weekly_returns
from quantloom.sources import tables as T

DAYS = [datetime.date(2020, 1, 5) + datetime.timedelta(7 * i) for i in range(40)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tables", [1, 3])
def test_pairs_of_stored_blocks_are_read_apart(spark, monkeypatch, tables):
    monkeypatch.setattr(M, "PAIR_BLOCK", 4)
    monkeypatch.setattr(M, "PAIR_MOST", 6)
    monkeypatch.setattr(M, "PAIR_TILE", 3)
    x = np.random.default_rng(5).normal(0, 0.02, (40, 23))
    x[np.random.default_rng(6).random(x.shape) < 0.2] = np.nan
    wide = pd.DataFrame(x, index=DAYS)
    rows = [(int(s), d, None if np.isnan(v) else float(v)) for s in wide for d, v in wide[s].items()]
    returns = spark.createDataFrame(rows, "symbol long, date date, ret double")
    out = M.covariances(*[returns.filter(f"symbol % {tables} = {i}") for i in range(tables)])
    assert "Exchange" not in plan(out)
    # 6 blocks of 23 symbols: a task for each of their 21 pairs.
    assert out.rdd.getNumPartitions() == 21
    got, cov, corr = out.toPandas(), wide.cov(), wide.corr()
    assert len(got) == 23 * 24 // 2 == len(got.drop_duplicates(["a", "b"])) and (got["a"] <= got["b"]).all()
    for r in got.itertuples():
        assert r.cov == pytest.approx(cov.loc[r.a, r.b], abs=1e-12) and r.corr == pytest.approx(corr.loc[r.a, r.b], abs=1e-9)
        assert r.n == (wide[r.a].notna() & wide[r.b].notna()).sum()


def test_parts_of_suppliers_give_all_weeks_with_one_shuffle_each(spark, sf, monkeypatch):
    want = {tuple(r) for r in weekly_returns(spark, sf).collect()}
    monkeypatch.setattr(T, "PART_LINES", 2500)
    parts = [weekly_returns(spark, sf, p) for p in T.bars_in_parts(spark, sf)]
    rows = [[tuple(r) for r in p.collect()] for p in parts]
    assert len(parts) == 3 and sum(map(len, rows)) == len(want) and {r for p in rows for r in p} == want
    for p in parts:
        assert plan(p.groupBy("symbol").count()).count("Exchange hashpartitioning") == 1
    symbols = [{r[0] for r in p} for p in rows]
    assert sum(map(len, symbols)) == len(set().union(*symbols))


def test_query_in_parts_gives_the_same_pairs(spark, sf, monkeypatch):
    want = sorted(map(tuple, performance.covariance_pairs(spark, sf).collect()))
    monkeypatch.setattr(T, "PART_LINES", 2500)
    monkeypatch.setattr(M, "PAIR_MOST", 3)
    assert sorted(map(tuple, performance.covariance_pairs(spark, sf).collect())) == want

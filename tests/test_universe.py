"""Queries that fit a universe take all of it: sf0.01 has 100 symbols, more than any subset they once took."""

import pytest

from quantloom import catalog
from quantloom.operators import estimators as E
from quantloom.operators import forecast as X
from quantloom.operators import calibration as K
from quantloom.operators import holdings as O
from quantloom.operators import statements as S

SF = "/root/testdata/sf0.01"
CASES = {"calibration": (K, "calibrate", 0), "shrinkage_covariance": (E, "shrunk_covariances", 0), "optimal_allocations": (O, "allocations", 1), "joint_paths": (X, "joint_paths", 0), "style_exposures": (S, "style_exposures", 0), "style_factor_returns": (S, "style_exposures", 0)}


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", CASES)
def test_takes_every_symbol(spark, monkeypatch, name):
    module, fn, at = CASES[name]
    given = {}

    def catch(*args, **kwargs):
        given.update(kwargs, panel=args[at])
        raise Stop

    monkeypatch.setattr(module, fn, catch)
    with pytest.raises(Stop):
        catalog.queries()[name](spark, SF)
    symbols = {r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()}
    assert len(symbols) == 100 and {r[0] for r in given["panel"].select("symbol").distinct().collect()} == symbols
    if name == "optimal_allocations":
        assert set(given["blends"]) == set(O.BLENDS) and len(O.BLENDS) == 14
    if name == "joint_paths":
        assert given["sims"] == 2000


def test_joint_paths_of_every_symbol(spark):
    assert catalog.queries()["joint_paths"](spark, SF).count() == 101

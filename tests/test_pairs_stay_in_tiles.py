"""Covariances over several tiles: right, and no row per pair goes through a shuffle."""

import datetime as dt

import numpy as np
import pytest

from tidepanel.functions import tiles
from tidepanel.operators import risk


@pytest.fixture
def panel(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 3)
    monkeypatch.setattr(tiles, "BLOCK", 8)
    monkeypatch.setattr(tiles, "TILES", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (11, 9)) * (rng.random((11, 9)) < 0.7)
    x[4] = 0
    x[4, 2] = 1.5
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(t), float(x[i, t]), "EQUITY" if i % 3 else "TEFAS_FREE") for i in range(11) for t in range(9) if x[i, t]]
    return spark.createDataFrame(rows, "symbol long, ts date, ret double, asset_type string"), x


def _above_python(df):
    """Operators of the plan above the first Python stage."""
    return df._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_pairs_equal_numpy_and_are_not_shuffled(panel):
    df, x = panel
    want = np.cov(x)
    out = risk.pair_covariance(df)
    got = {(r.sym_i, r.sym_j): r.cov for r in out.collect()}
    assert set(got) == {(i, j) for i in range(11) for j in range(i, 11)}
    assert all(abs(v - want[k]) < 1e-12 for k, v in got.items())
    assert "Exchange" not in _above_python(out) and "Aggregate" not in _above_python(out)


def test_diagonal_and_row_sums_equal_those_of_all_pairs(panel):
    df, x = panel
    want = np.cov(x)
    assert all(abs(r.cov - want[r.sym_i, r.sym_i]) < 1e-12 for r in risk.variances(df).collect())
    a, b = risk.panel_bounds(df).first(), risk.cov_bounds(risk.pair_covariance(df)).first()
    assert abs(a.lower - b.lower) < 1e-12 and abs(a.upper - b.upper) < 1e-12 and a.surely_definite == b.surely_definite


def test_one_point_of_the_grid_has_no_covariance(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 0.5), (2, dt.date(2024, 1, 1), 0.1)], "symbol long, ts date, ret double")
    assert [r.cov for r in risk.pair_covariance(df).collect()] == [None] * 3
    assert risk.panel_bounds(df).first().lower is None


def test_fast_block_and_all_other_pairs(spark, panel):
    df, x = panel
    fast = df.where("asset_type = 'EQUITY'")
    out = risk.bitemporal_cov(fast, df, spark.createDataFrame([(50.0,)], "kappa double"))
    got = {(r.sym_i, r.sym_j): r.cov for r in out.collect()}
    own = [i for i in range(11) if i % 3]
    used = x[own][:, (x[own] != 0).any(0)]
    want = np.cov(x) * 5
    want[np.ix_(own, own)] = np.cov(used) * 50
    assert set(got) == {(i, j) for i in range(11) for j in range(i, 11)}
    assert all(abs(v - want[k]) < 1e-10 for k, v in got.items())


def test_tiles_do_not_grow_in_number(spark):
    x = spark.range(5000).selectExpr("id as symbol")
    assert tiles.fitted(x, spark.createDataFrame([(80,)], "g long")).agg({"n_tiles": "max"}).first()[0] <= 16
    assert tiles.fitted(x, spark.createDataFrame([(1 << 16,)], "g long")).agg({"pos": "max"}).first()[0] < (1 << 23) / (1 << 16)

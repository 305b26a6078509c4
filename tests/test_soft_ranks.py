"""Sums of clamped logistics equal those over all pairs, and no pairs are joined."""

import datetime as dt

import numpy as np
import pytest

from tidepanel.functions import softrank
from tidepanel.operators import evaluation


def _pairs(z, tau, clamp):
    return (1 / (1 + np.exp(-np.clip((z[None, :] - z[:, None]) / tau, -clamp, clamp)))).sum(1)


@pytest.mark.parametrize("tail", [0.0, 3.0])
@pytest.mark.parametrize("n", [1, 2, 50, 1500])
def test_sums_equal_those_of_all_pairs(n, tail):
    rng = np.random.default_rng(n)
    z = rng.normal(0, 1, n) * np.exp(tail * rng.random(n))
    z[: n // 5] = np.round(z[: n // 5], 1)  # ties and pairs at the clamp
    assert np.abs(softrank.sums_of_date(z, 0.1, 10.0) - _pairs(z, 0.1, 10.0)).max() < 1e-9


def test_loss_joins_no_pairs(spark):
    rows = [(dt.date(2024, 1, 1), i, i / 7, float(i % 3)) for i in range(20)]
    out = evaluation.soft_ndcg_loss(spark.createDataFrame(rows, "date date, symbol long, score double, actual double"))
    assert out.first().soft_loss is not None
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()

"""The rolling dataset is made in one pass over the bars."""

import datetime as dt
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tidepanel.operators import crosssec, factors

SMALL = "/root/testdata/sf0.001"
D = dt.date(2020, 1, 1)


def test_bars_are_made_once_and_each_window_function_is_asked_for_once(spark):
    plan = entry.queries()["h07_rolling_dataset"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_suppkey") == 1
    windows = [line for line in plan.split("\n") if " Window [" in line]
    assert sum(line.count("stddev_pop(") for line in windows) == 5
    assert sum(line.count("stddev_samp(") for line in windows) == 1
    assert "ObjectHashAggregate" not in plan
    x = spark.createDataFrame([("A", D, "EQUITY", 1.0)], "symbol string, date date, asset_type string, x double")
    plan = crosssec.class_zscore(x, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("stddev_pop(") == 1


@pytest.mark.parametrize("volume", [True, False])
@pytest.mark.parametrize("short,long", [(3, 9), (3, 8), (4, 4)])
def test_means_over_both_spans(spark, volume, short, long):
    rng = random.Random(4)
    rows = [(s, D + dt.timedelta(days=2 * k), rng.uniform(1, 9), None if (s, k) == (2, 17) else rng.uniform(1, 5)) for s, n in ((1, 30), (2, 40), (3, 2)) for k in range(n)]
    if not volume:
        rows = [(s, d, None if v is None else c, 1.0) for s, d, c, v in rows]
    df = spark.createDataFrame(rows, "symbol long, date date, close double, volume double")
    got = {(r.symbol, r.date): r.vwap_ratio for r in factors.horizon_factors(df if volume else df.drop("volume"), short, long).collect()}
    assert len(got) == len(rows)
    for s in (1, 2, 3):
        own = [r for r in rows if r[0] == s]

        def mean(i, n):
            part = own[i - n + 1 : i + 1] if i + 1 >= n else []
            return np.average([c for _, _, c, _ in part], weights=[v for *_, v in part]) if part and all(c is not None and v is not None for _, _, c, v in part) else None

        for i, (_, date, _, _) in enumerate(own):
            near, far = mean(i, short), mean(i, long)
            assert got[s, date] == (None if near is None or far is None else pytest.approx(near / far - 1, abs=1e-12))


def test_another_calendar_gives_the_same_rows(spark):
    rng = random.Random(5)
    rows = [(s, D + dt.timedelta(days=k), ["EQUITY", "TEFAS_FREE"][s % 2], rng.uniform(1, 9), rng.uniform(1, 5)) for s in range(4) for k in range(120) if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "symbol long, date date, asset_type string, close double, volume double")
    want = sorted(map(tuple, factors.rolling_dataset(df).select("symbol", "date", *factors.HORIZON, "target").collect()))
    got = sorted(map(tuple, factors.rolling_dataset(df, calendar=df.select("date").union(df.select("date"))).select("symbol", "date", *factors.HORIZON, "target").collect()))
    assert got == want and {r[1] for r in want} == {D + dt.timedelta(days=k) for k in range(63, 120 - 22)}

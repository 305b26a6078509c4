"""A price of zero is a price: returns around it are infinite and no query stops."""

import math
from datetime import datetime

from pyspark.sql import Row

from tidepanel.functions.windows import ln, ratio
from tidepanel.operators import risk
from tidepanel.streaming import streams


def test_returns_around_a_price_of_zero(spark):
    x = spark.createDataFrame([(1, "EQUITY", datetime(2024, 1, d, 10), p) for d, p in ((1, 2.0), (2, 0.0), (3, 0.0), (4, 5.0), (5, 10.0))], "symbol long, asset_type string, ts timestamp, price double")
    got = [r.ret for r in risk.daily_close_returns(x).orderBy("date").collect()]
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == math.inf and abs(got[3] - math.log(2)) < 1e-12


def test_ratio_and_ln_as_floating_point(spark):
    x = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    got = [r[0] for r in x.select(ratio(x.a, x.b)).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, None, 1.5]
    logs = [r[0] for r in x.select(ln(x.a)).collect()]
    assert logs[0] == 0 and math.isnan(logs[1]) and logs[2] == -math.inf and logs[3] is None


def test_sentinel_and_decision_after_a_price_of_zero():
    signal = Row(ts=None, is_signal=True, price=None, stop=0.0, atr=0.0, prev_close=0.0)
    state, _ = streams._watch((1,), None, signal)
    tick = lambda p: Row(ts=None, is_signal=False, price=p, stop=None, atr=None, prev_close=None)
    assert streams._watch((1,), state, tick(5.0))[1] == []
    assert streams._watch((1,), state, tick(0.0))[1][0][-1] == "STOP"
    day = Row(date=None, close=1.0, atr=0.1, p_success=0.6)
    assert streams._decide((1,), (0, 0.5, 3, 0.0), day)[0] == (1, 0.6, 4, 1.0)

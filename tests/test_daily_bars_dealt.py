"""Bars by symbol are dealt once, in tasks of a bounded number of rows."""

from tidepanel.operators import risk
from tidepanel.plans import views

SMALL = "/root/testdata/sf0.001"


def test_one_shuffle_and_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    rows = views.base(spark, SMALL, "lineitem").count()
    bars = views.view(spark, SMALL, "daily_bars")
    for out in (bars, risk.auction_ratio_ma20(bars), risk.adv20(bars), risk.log_returns(bars)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "hashpartitioning(l_suppkey" in plan
    assert bars.rdd.getNumPartitions() >= rows / 500

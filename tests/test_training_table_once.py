"""The training table is computed once, whatever number of passes the fits make."""

import os

import pytest

from tidepanel.plans import queries_decisions
from tidepanel.plans.registry import Tables

DATA = os.environ.get("PANEL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_train_and_test_rows_come_from_files(spark):
    for part in queries_decisions.training_table(Tables(spark, DATA)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "FileScan" in plan
        assert part.count() > 0

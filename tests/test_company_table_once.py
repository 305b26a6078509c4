"""The company table of the fusion is computed once for all of its scores."""

from tidepanel.plans import queries_decisions
from tidepanel.plans.registry import Tables


def test_scores_read_one_written_table(spark):
    facts = queries_decisions.fusion_facts(Tables(spark, "/root/testdata/sf0.001"))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "FileScan" not in plan
    assert facts.count() > 0

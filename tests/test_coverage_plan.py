"""How texts are dealt for the fingerprint of covered files."""

from __future__ import annotations

from gristmill.plans import gates


def test_texts_are_dealt_to_no_fixed_number_of_tasks(spark):
    plan = gates.fresh_coverage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan

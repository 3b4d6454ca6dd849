"""Physical plans of the training-data queries."""

import pytest

from strandline.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_nothing_passes_through_one_task(llm, small, name):
    before = llm.conf.get("spark.sql.autoBroadcastJoinThreshold")
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](llm, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        llm.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SinglePartition" not in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert name != "op3_rules" or "Arrow" not in plan and "Python" not in plan

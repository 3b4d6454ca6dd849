"""Physical plans: what must not be in them, and what must reach the scan."""

import re

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from suite.registry import QUERIES

# One-row or report-size results may end in one partition; nothing else may pass through one.
SMALL_END = {"overall_mean_gap"}
WRITES = {"metric_file_scan", "overwrite_result", "append_with_stamp", "declare_result", "report_export", "load_condition_table", "load_conditions"}


def plan_of(spark, small, name):
    return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Plans as they look when no side is small enough to broadcast on its own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITES])
def test_plan_scales(spark, small, no_broadcast, name):
    plan = plan_of(spark, small, name)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan
    if name not in SMALL_END:
        assert "SinglePartition" not in plan
    # The only hinted broadcasts are the bounded lists of large persons and keys.
    for line in plan.splitlines():
        if "BroadcastHashJoin" in line:
            assert "<=>" in line or "coalesce" in line


def test_period_filter_and_columns_reach_the_scan(spark, small):
    plan = plan_of(spark, small, "closed_range_filter")
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>", plan)
    plan = QUERIES["stamp_range_filter"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan


def test_file_scans_take_pushed_filters(spark, tmp_path):
    from strandline.functions import labels
    from strandline.plans.conditions import Calendar

    path = str(tmp_path / "t")
    spark.sql("SELECT 1 AS k, DATE '2020-01-01' AS svc_date, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS call_stamp").write.parquet(path)
    df = spark.read.parquet(path)
    for condition in (
        labels.in_closed_range("svc_date", "2020-01-01", "2020-12-31"),
        Calendar("2020-01-01", 3, 24).covers("svc_date"),
    ):
        plan = df.filter(condition)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(svc_date" in plan and "LessThanOrEqual(svc_" in plan
    plan = df.filter(labels.stamp_in_range("call_stamp", "2020-01-01", "2020-12-31"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(call_stamp" in plan and "LessThanOrEqual(call_" in plan


def test_top_ranks_are_cut_before_the_shuffle(spark, small):
    plan = plan_of(spark, small, "id_crosswalk_wide")
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_conditions_share_one_pass(spark, small, no_broadcast):
    """Both conditions of the run read the diagnoses once."""
    plan = plan_of(spark, small, "multi_condition_run").split("Initial Plan")[-1]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", plan)) == 1


def test_routes_for_large_persons_share_the_steps_before_them(spark, small):
    """The intakes are read and made distinct once; both routes take the shuffle output."""
    df = QUERIES["episode_gaps"](spark, small)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reuse is visible only in a plan fixed ahead
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan

"""What the physical plans must and must not contain."""

import re

import pytest

from strataflow.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text


ROW_SCANS = ["w4_daily_increment", "w1_hole_phases", "w3_depth_reversals", "w5_hole_runs", "n6_duration_hrs", "a6_time_breakdown", "t6_bha_runs_list"]


@pytest.mark.parametrize("name", ROW_SCANS)
def test_rows_are_never_windowed_by_well_alone(spark, name):
    """Windows over a whole well run on chunk summaries (``_s_``), not on rows."""
    windows = re.findall(r"Window \[(.*)\], \[well#\d+\]", plan(spark, name))
    assert windows and all("_s_" in w for w in windows)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "a23_risk_benchmark")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    assert "props" not in text
    production = plan(spark, "a24_production_summary")
    assert "PushedFilters" in production


@pytest.mark.parametrize("name", ["t3_issue_timeline", "r4_ddr_narrative", "r5_problem_summaries", "r6_bha_comment_evidence", "r1_keyword_search"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)

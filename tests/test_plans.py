"""Properties of the physical plans."""

import re

import pytest

from conftest import SMALL
from gatewright.catalog import registered
from gatewright.catalog.registry import callable_for

QUERIES = {name: callable_for(fn) for name, (fn, _) in registered().items()}
STREAMS_AND_LOOPS = {"j8_apply_answers", "j8_products", "j8_requests", "j8_answers", "j8_events", "l1_stream_counts", "l2_stream_latest_status", "l3_stream_upsert", "l4_stream_stage_machine"}


def plan_of(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS_AND_LOOPS))
def test_no_python_and_no_cross_joins(spark, name):
    plan = plan_of(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "b1_equality_filter")
    assert "EqualTo(o_custkey,42)" in plan
    assert "struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    plan = plan_of(spark, "d10_filtered_max")
    assert "l_extendedprice" not in plan


def test_gating_keeps_one_partitioning_and_hash_aggregation(spark):
    plan = plan_of(spark, "j6_workflow_gating")
    assert "SortAggregate" not in plan and "Window" not in plan
    keys = re.findall(r"Exchange hashpartitioning\((\w+?)#", plan)
    assert keys.count("data_product_id") == 2 and keys.count("request_id") == 2


def test_first_changes_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "e7_first_six_and_more")

"""Plan-shape guards over every registered query (sf0.001 plans)."""

import pytest

import __spark_entry__ as E

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
TOP_K = ("retrieval_topk", "stratified_sample")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_join_or_row_udf(spark, name):
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_limits_before_shuffle(spark, name):
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F
    from quarry.plans import fixtures as fx
    df = fx.table(spark, "/root/testdata/sf0.001", "lineitem").where(F.col("l_orderkey") < 10).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,10)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan

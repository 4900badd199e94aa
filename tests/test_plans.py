"""Plan shape guards over every registered query (plans only, sf0.001)."""

import __spark_entry__ as E

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(spark, name):
    return E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_or_row_udfs(spark):
    bad = []
    for name in E.queries():
        if name.startswith(("k2_", "k3_")):          # streaming queries run when called
            continue
        plan = _plan(spark, name)
        bad += [(name, w) for w in FORBIDDEN if w in plan]
    assert bad == []


def test_threshold_filter_reaches_the_scan(spark):
    plan = _plan(spark, "c1_topic_threshold")
    assert "PushedFilters: [IsNotNull(score_topic), GreaterThanOrEqual(score_topic,0.6)]" in plan


def test_sweep_shuffles_partial_aggregates_only(spark):
    plan = _plan(spark, "q2_agreement_sweep")
    assert plan.count("Exchange hashpartitioning(election") >= 2
    assert "partial_count" in plan and "partial_sum" in plan
    assert "SortMergeJoin" not in plan


def test_cleaning_runs_once_per_row(spark):
    plan = _plan(spark, "h_clean_p1")
    assert "Generate explode(array(" in plan
    assert plan.count("regexp_replace(tweet") == 1

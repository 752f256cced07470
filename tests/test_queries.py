"""Every registered query against its SQL, and plan properties that matter at scale."""

import pytest
from oracle import connect, differences

from noticelake.catalog.oracles import ORACLES
from noticelake.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_registry():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    assert differences(frame.collect(), frame.columns, con, ORACLES[name]) == []


LAZY = ["q01_feed", "q06_dedupe_first", "q07_change_feed", "q08_circuit_breaker", "q12b_index_documents",
        "q16_keyword_boards", "q19_merge_sources", "q21_run_stats", "q24_manual_review", "q26_extract_rows"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_feed_is_a_top_k_with_pushed_filters(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "q01_feed")
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "o_totalprice" not in plan


def test_index_of_unique_ids_needs_no_shuffle(spark, sf_dir):
    # Spreading a table of one file over the cores is no shuffle by key.
    assert "hashpartitioning" not in plan_of(spark, sf_dir, "q12b_index_documents")


def test_extraction_needs_no_shuffle(spark, sf_dir):
    assert "hashpartitioning" not in plan_of(spark, sf_dir, "q26_extract_rows")


def test_summary_counts_shrunk_rows(spark, sf_dir):
    # The Expand of the distinct counts sits above an aggregation, not above the rows.
    plan = plan_of(spark, sf_dir, "q03_notice_stats")
    assert plan.index("Expand") < plan.rindex("HashAggregate")

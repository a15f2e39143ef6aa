"""Physical plans of the registered queries."""

import pytest

import __spark_entry__  # noqa: F401
from repoatlas.plans.registry import QUERIES
from tests.conftest import SMALL

STREAMED = {n for n in QUERIES if n.startswith("stream_")}
PYTHON = {"lead3_summary", "classify_embedding", "knn_topk"}


def plan(spark, name: str) -> str:
    df = QUERIES[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_cross_join_and_no_python_where_not_needed(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    in_python = any(node in text for node in ("MapInPandas", "MapInArrow", "EvalPython", "FlatMap"))
    assert in_python == (name in PYTHON)


def test_top_k_never_sorts_the_table(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_k")


def test_ranking_limits_each_task_first(spark):
    for name in ("bm25_rank", "knn_topk", "extract_topics"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in plan(spark, "top_k")
    assert "text" not in plan(spark, "report_toc")


def test_row_wise_text_work_is_not_shuffled_twice(spark):
    for name in ("clean_readme", "is_relevant_context", "classify_hybrid", "detect_language"):
        assert plan(spark, name).count("Exchange") <= 1


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan(spark, "exclude_list")

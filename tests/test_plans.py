"""What the plans must and must not hold."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

SMALL = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not there")


def plan(spark, name):
    return contract.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["trial_grid_similarity", "attribute_pairs", "work_plan", "block_links", "attribute_pair_means", "plain_split",
     "pooled_vectors", "statement_report_matches", "hybrid_fused_ranks", "pairwise_kappa", "confusion_matrix"],
)
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_equal")
    assert "EqualTo(event_type,purchase)" in text
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in text
    text = plan(spark, "keyword_filter")
    assert "In(source, [src1,src2,src3])" in text


@pytest.mark.parametrize("name", ["top_per_model", "keep_first_user_event", "first_per_group", "matched_arrays"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name) and "Partial" in plan(spark, name)


@pytest.mark.parametrize("name", ["term_document_counts", "word_pairs", "misclassified_rows", "majority_of_models"])
def test_row_local_work_shuffles_no_results(spark, name):
    """Only the optional spreading of a small scan (or the join with its labels) may appear."""
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") <= 1
    assert "Window" not in text and "HashAggregate" not in text


@pytest.mark.parametrize("name", ["token_table", "sentence_future_flag", "future_sentence_table", "tfidf_weights"])
def test_row_local_work_has_no_second_exchange(spark, name):
    """At most the layout of a table of one file; no window, join or grouping of tokens."""
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") <= 1 and "Window" not in text and "Join" not in text

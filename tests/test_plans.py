"""Physical plans: no row-at-a-time Python, no product joins, filters and columns reach the scan."""

import pytest

from tabularium.plans import REGISTRY
from tests.conftest import FOLDER

CHECKED = """select_filter_order_limit join_three_resources star_join_category_totals revenue_per_segment top_lines_per_order
previous_value_per_series requests_last_minute field_quality word_chunks keyword_search semantic_search query_intent
correlations z_score_outliers spikes_and_drops content_duplicates versions_to_prune json_profile_flat field_mappings
resource_ranking_analyst""".split()


def plan_of(spark, name):
    frame = REGISTRY[name].run(spark, FOLDER)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_products_and_no_row_python(spark, name):
    plan = plan_of(spark, name)
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name} plans {bad}"


def test_filter_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(spark, "select_filter_order_limit")
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice" in plan
    assert "o_orderdate" not in plan.split("ReadSchema: ")[1]


def test_top_k_is_pruned_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "top_lines_per_order")


def test_latest_state_is_combined_before_the_shuffle(spark):
    plan = plan_of(spark, "upload_statistics")
    assert plan.count("partial_max_by") >= 1

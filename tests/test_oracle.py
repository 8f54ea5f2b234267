"""Registered queries against DuckDB. A quick selection by default, all with TABULARIUM_ALL=1."""

import os

import pytest

from tabularium.plans import REGISTRY
from tests.conftest import FOLDER
from tests.oracle import compare, connect

QUICK = """select_filter_order_limit permission_check join_three_resources coalesce_overlapping_sources revenue_per_segment
result_batches previous_value_per_series requests_last_minute strip_whitespace missing_fill_mode detect_types clean_table
numeric_summary field_quality remove_headers_footers word_chunks query_variations semantic_search keyword_search hybrid_search
query_intent extract_references document_sector trend_per_event_type correlations z_score_outliers spikes_and_drops
linear_forecast catalog_statistics audit_statistics upload_statistics message_flow idle_sessions versions_to_prune
content_duplicates audit_chain json_profile_nested document_rows field_mappings schema_conflicts harmonised_union bulk_ingest
audit_scan""".split()
NAMES = list(REGISTRY) if os.environ.get("TABULARIUM_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5

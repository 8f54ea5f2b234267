"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose data and threads.
Every query runs once untimed, so JVM start-up and code generation are not part of the figure.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tabularium.plans import REGISTRY
from tabularium.session import build_session

HEADLINE = """
revenue_per_segment star_join_category_totals join_three_resources group_where_having conditional_rate top_lines_per_order
previous_value_per_series result_batches requests_last_minute derived_field clean_table detect_types numeric_summary field_profile
quality_dimensions json_profile_nested json_profile_flat json_clean word_chunks clean_text_chunks chunks_semantic html_text content_duplicates
keyword_search semantic_search hybrid_search mmr_search query_intent document_sector trend_per_event_type correlations
z_score_outliers isolation_outliers spikes_and_drops linear_forecast autoregressive_forecast catalog_statistics
audit_statistics audit_chain rate_limit_decisions idle_sessions versions_to_prune field_mappings harmonised_union
csv_round_trip bulk_ingest stream_audit_counts
""".split()


def run(spark, folder: str, name: str) -> float:
    start = time.time()
    frame = REGISTRY[name].run(spark, folder)
    frame.write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, folder, name)
        seconds[name] = round(run(spark, folder, name), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

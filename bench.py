"""Time the headline queries. Prints one JSON line.

Each query runs twice and the second run counts; the first compiles code and warms the page cache.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names or "all") change the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registra.plans.catalog import QUERIES  # noqa: E402
from registra.session import clear_work, local_session, ship_package  # noqa: E402

HEADLINE = (
    "a01_total", "a03_distinct_count", "a04_count_by_year", "a05_top_groups", "a07_dashboard",
    "a08_budget_by_year", "a09_top_by_sum", "a11_bucket_counts", "a12_budget_bundle",
    "a13_keyword_cells", "a15_keyword_trends", "a16_institution_nodes", "a18_city_rollup",
    "a22_numeric_profile", "a23_log_histogram", "a24_top_terms", "a25_topic_nodes",
    "a26_topic_edges", "a27_institution_edges", "c02_fill_rates", "c10_dedup_keep_last",
    "c15_clean_records", "f05_filter_spec", "g01_institution_edges", "j03_shared_member_pairs",
    "j07_first_match", "j09_cooccurrence_pairs", "m02_apply_updates", "m04_upsert",
    "s01_read_snapshots", "t01_page", "v02_embed_texts", "v04_semantic_search",
    "v06_retrieve_context", "v08_build_prompts", "w01_yearly_rank", "w07_top_k_per_group",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = sorted(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    ship_package()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()

    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        clear_work(spark)
    print(json.dumps({
        "metric": "headline_queries_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

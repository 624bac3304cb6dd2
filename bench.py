"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import re
import time

from billscope.queries import QUERIES
from billscope.shared import build_session

HEADLINE = [
    "a6_rate_two_level", "a3_multivalue_counts", "a8_nested_conditional_counts", "a9_describe", "a10_corr",
    "a14_mode_share", "a17_histogram30", "a19_box_stats", "c1_tfidf", "c4_weighted_best_similarity",
    "c6_nearest_centroid", "c8_silhouette_1d", "c9_davies_bouldin", "f1_split_trim", "f3_first_uf", "j1_enrich_authors",
    "j2_first_last_movement", "j6_month_key_join", "j8_active_on_date", "j9_asof_first_match",
    "j11_keyword_rules_exact", "m3_stratified_split", "p13_faceted_search", "s1_paged_scan", "w1_duplicate_flag",
    "w2_open_close_periods", "w3_value_runs", "a18_density", "c5_kmeans", "c7_k_sweep", "m6_logistic",
    "m14_attribution",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "billscope-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "a6_rate_two_level", sf_dir)  # warm the JVM before the clock counts
    times = {name: round(run(spark, name, sf_dir), 3) for name in wanted}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

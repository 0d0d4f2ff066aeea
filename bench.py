"""Benchmark of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.  Every query runs to a noop
sink after one warm-up query; BENCH_QUERIES (comma-separated) runs others.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.all_queries import QUERIES  # noqa: E402
from clonespan.session import local_session  # noqa: E402

HEADLINE = [
    "agg1_aa_clone_table", "agg5_sample_summary", "src1_clone_lines", "fea4_top_k", "fea9_kmers", "fea12_core_table", "flt4_vocabulary_filter", "pub3_catalog",
    "pub7_overlap_features", "pub12_leave_one_out", "pub13_crossfit", "stb2_iteration_sizes", "spl3_imbalance_score", "spl10_best_distinct", "eva12_repeat_metrics",
    "eva10_threshold_rules", "spl18_bootstrap_intervals", "eva20_coefficient_stability", "mod4_standardised_values", "mod7_elastic_net_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, max(4, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["dq7_fingerprint"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

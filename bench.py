"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from epicell.session import local_session  # noqa: E402

RUNS = 3
HEADLINE = (
    "window_features window_features_live m2_window_features forward_labels followup_exists elapsed_since_last"
    " radius_count background_rate nearest_station nearest_vertex_km nearest_line_km nearest_centroid_attr"
    " compute_features union_catalogs encode_first_seen join_features_labels apply_cleaning_rules impute_by_prefix"
    " high_corr_pairs column_cardinality null_rates roc_auc average_precision eval_snapshots threshold_sweep_f2"
    " radius_join background_rate_live m2_window_features_live split_random classification_report scored_feed upsert_scored_events feature_selection latest_run_per_key top_zones histogram"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    checks.load()
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    checks.QUERIES["decade_counts"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not a query
    # the first neighbour join compiles what the others share
    checks.PLAIN["window_features_live"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.time()
            checks.PLAIN[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

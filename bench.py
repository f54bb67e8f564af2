"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from acrely.plans.queries import QUERIES  # noqa: E402
from acrely.session import local_session  # noqa: E402

HEADLINE = [
    "features_enriched", "investment_bulk", "investment_grade_by_city", "describe_all", "boxplot_by_city", "city_stats_lakhs",
    "price_histogram", "price_corr", "anomaly_summary", "anomaly_reasons", "isolation_forest", "train_test_split",
    "recommend_batch", "recommend_no_city", "embedding_topk", "listing_cards", "inventory_upsert", "booking_transitions",
    "event_counts_sliding", "session_windows", "model_linear", "model_ridge", "stream_login_state", "stream_scoring",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory="16g")
    QUERIES["bedroom_counts"](spark, folder).collect()  # start the JVM before the clock
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

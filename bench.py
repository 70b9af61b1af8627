"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_weekend_by_city", "p2_still_active", "p7_search_terms", "p9_family_relevance", "c1_type", "c4_age_info", "c5_cost_info",
    "w1_keep_last_per_key", "w3_three_per_source", "w8_failure_streaks", "a1_series_cards", "a1_series_sessions", "a3_publication_funnel",
    "j2_collection_references", "x2_plain_text", "e6_page_facts", "st1_first_impressions",
    "k1_recommendation_score", "j3_pick_resolution", "g2_first_results", "w5_base_ranking",
]


def main() -> None:
    from daybill.checks import load
    from daybill.plans.listings import Tables
    from daybill.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    tables, checks = Tables(spark, folder, spread=int(os.environ.get("BENCH_CPUS", "8"))), load()
    tables.lineitem.groupBy("l_returnflag").count().collect()  # start the JVM's code paths
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        times = []
        for _ in range(repeats):
            start = time.perf_counter()
            checks[name].build(tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times)[len(times) // 2], 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()

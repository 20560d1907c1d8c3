"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
Each query is written to the noop sink, so every row and column is computed and
nothing is brought to the driver. The first query is run once untimed to warm up.
"""
from __future__ import annotations

import json
import os
import sys
import time

from fieldledger.session import local_session

HEADLINE = [
    "label_lift", "label_lift_by_month", "calibrate_effort", "trips_frame", "stratified_effect", "label_evidence",
    "tag_effects", "band_effects", "split_half", "expected_rate", "recommend_units", "rolling_origin_backtest",
    "unit_consistency", "rate_summary", "conditions_rows", "similar_obs", "interval_expand_daily",
    "report_features", "vocab_tags_documents", "label_parse_field", "distinctive_phrases", "html_to_text",
    "parse_report_page", "parse_listing_cards", "build_units", "build_trips", "geo_pick_candidate",
    "geo_rank_candidates", "upsert_latest", "stream_ingest_latest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=max(1, int(cpus)) if cpus.isdigit() else 8)
    from fieldledger.plans.catalog import QUERIES
    wanted = sys.argv[1:] or HEADLINE
    QUERIES[wanted[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
